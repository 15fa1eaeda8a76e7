"""Matching a client's literals in its documents: exact word runs first, looser ways for what they leave open.

Words are matched by equi-joins on the first normalized word (or a prefix of it), never literal by literal. The ways,
in the order of their number: 1 exact word sequence; 1b sequence with other words between, where 1 found nothing on
the page; 1c the literal's letters in one line with other spacing, or as the beginning of a word, in lines not hit yet;
2 inside a word, between signs; 3 inside a line's content, in lines not hit yet; 4 across lines, where nothing else
was found on the page. Equal boxes are reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import normalized, target_words
from veilspark.operators.places import VIEWER_STRIP, Marks, folded, lines_of, longest, word_places
from veilspark.sources.layout import KEY
from veilspark.sources.tables import stored

HIT = [*KEY, "entity"]
MOST_LISTED = 500  # literals of a client that its lines are held against one by one
MOST_SPAN = 100  # points between the first and last word of a sequence with gaps
OUT = [*HIT, "strategy", "line_id", "left", "top", "right", "bottom", "partial", "full_text"]


def flat_words(word_table: DataFrame) -> DataFrame:
    """Words of a page in reading order (of their rounded places): pos from 0, norm, and how many words their line has."""
    order = Window.partitionBy(*KEY).orderBy(F.bround("top"), F.bround("left"), "line_id", "word_index")
    line = Window.partitionBy(*KEY, "line_id")
    return word_table.withColumn("pos", F.row_number().over(order) - 1).withColumn("norm", normalized(F.col("text"))).withColumn("line_words", F.count("*").over(line))


def prepared(literals: DataFrame) -> DataFrame:
    """client_id, entity, targets (normalized words), joined (their letters), first word, n."""
    rows = literals.select("client_id", F.trim("entity").alias("entity")).distinct().where("entity != ''").withColumn("targets", target_words(F.col("entity")))
    return rows.withColumn("joined", F.array_join("targets", "")).withColumn("n", F.size("targets")).withColumn("first", F.try_element_at("targets", F.lit(1)))


def not_overlapping(starts: str, n: str) -> Column:
    """SQL: of sorted starts, those that aren't inside the run of n words of the one taken before, leftmost first."""
    return F.expr(f"aggregate({starts}, named_struct('next', -1, 'out', cast(array() as array<int>)), (s, x) -> if(x >= s.next, named_struct('next', x + {n}, 'out', concat(s.out, array(x))), s), s -> s.out)")


def char_left(at: str) -> Column:
    """The left edge of a word's character: by the column chars (an array of boxes), where there is one for each character, else at even widths."""
    return F.expr(f"if(size(chars) = char_length(text), chars[int({at})].left, left + (right - left) * ({at}) / char_length(text))")


def char_right(at: str) -> Column:
    return F.expr(f"if(size(chars) = char_length(text), chars[int({at})].right, left + (right - left) * ({at} + 1) / char_length(text))")


def with_chars(words: DataFrame) -> DataFrame:
    return words if "chars" in words.columns else words.withColumn("chars", F.lit(None).cast("array<struct<left:double,right:double>>"))


def line_boxes(line_table: DataFrame) -> DataFrame:
    return line_table.select(*KEY, "line_id", *(F.col(c).alias(f"l_{c}") for c in ("left", "top", "right", "bottom")))


def _by_line(runs: DataFrame, words: DataFrame, line_table: DataFrame, strategy: str) -> DataFrame:
    """Occurrences from runs(HIT, run, pos): one for each stretch of a run in one line. Height is the line's; so is the width where all its words are in."""
    rows = runs.join(words, [*KEY, "pos"])
    stretch = F.row_number().over(Window.partitionBy(*HIT, "run").orderBy("pos")) - F.row_number().over(Window.partitionBy(*HIT, "run", "line_id").orderBy("pos"))
    grouped = rows.withColumn("stretch", stretch).groupBy(*HIT, "run", "line_id", "stretch").agg(
        F.count("*").alias("n_hit"), F.first("line_words").alias("line_words"), F.min("left").alias("left"), F.max("right").alias("right"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("full_text"),
    )
    whole = F.col("n_hit") == F.col("line_words")
    boxed = grouped.join(line_boxes(line_table), [*KEY, "line_id"])
    return boxed.select(
        *HIT, F.lit(strategy).alias("strategy"), "line_id", F.when(whole, F.col("l_left")).otherwise(F.col("left")).cast("double").alias("left"), F.col("l_top").cast("double").alias("top"),
        F.when(whole, F.col("l_right")).otherwise(F.col("right")).cast("double").alias("right"), F.col("l_bottom").cast("double").alias("bottom"), F.lit(False).alias("partial"), "full_text", F.col("run").cast("int").alias("at"),
    )


def exact(words: DataFrame, literals: DataFrame, line_table: DataFrame) -> DataFrame:
    """Way 1: runs of words equal to the literal's, leftmost ones that don't overlap, also across lines."""
    hit = words.select(*KEY, "pos", "norm").join(literals.where("n > 0").select("client_id", F.col("first").alias("norm"), "entity", "targets", "n"), ["client_id", "norm"])
    # the words after the first one are looked up by their places: few rows, so the words themselves aren't gathered
    rest = hit.where("n > 1").select(*HIT, "n", F.col("pos").alias("start"), F.posexplode("targets").alias("j", "norm")).where("j > 0").withColumn("pos", F.col("start") + F.col("j"))
    whole = rest.join(words.select(*KEY, "pos", "norm"), [*KEY, "pos", "norm"]).groupBy(*HIT, "n", "start").count().where("count = n - 1")
    first = hit.where("n = 1").select(*HIT, "n", F.col("pos").alias("start")).unionByName(whole.select(*HIT, "n", "start"))
    starts = first.groupBy(*HIT, "n").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    runs = starts.select(*HIT, "n", F.explode(not_overlapping("starts", "n")).alias("run"))
    return _by_line(runs.select(*HIT, "run", F.explode(F.sequence("run", F.col("run") + F.col("n") - 1)).alias("pos")), words, line_table, "1")


def gapped(words: DataFrame, line_table: DataFrame, literals: DataFrame, found: DataFrame) -> DataFrame:
    """Way 1b: the words in order with others between, the earliest ones each time, at most MOST_SPAN points high.

    Only pages that hold every word of the literal and had no hit are looked at; their words are folded in order. The
    literal's words are taken greedily; a sequence that is too high is passed over, and the search goes on after it.
    """
    many = literals.where("n >= 2")
    needed = many.select("client_id", "entity", "n", F.explode(F.array_distinct("targets")).alias("norm"), F.size(F.array_distinct("targets")).alias("kinds"))
    there = words.select(*KEY, "norm").distinct().join(needed, ["client_id", "norm"])
    pages = there.groupBy(*HIT, "n", "kinds").count().where("count = kinds").select(*HIT).join(found.select(*HIT).distinct(), HIT, "left_anti")
    pages = pages.join(many.select("client_id", "entity", "targets", "n"), ["client_id", "entity"])
    mine = pages.join(words.select(*KEY, "pos", "norm", "top"), KEY).where(F.array_contains("targets", F.col("norm")))
    rows = mine.groupBy(*HIT, "targets", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "norm", "top"))).alias("w"))
    fold = """aggregate(w, named_struct('k', 0, 'seq', cast(array() as array<int>), 'lo', 0, 'hi', 0, 'out', cast(array() as array<array<int>>)),
      (s, x) -> case when x.norm != targets[s.k] then s
        when s.k + 1 < n then named_struct('k', s.k + 1, 'seq', concat(s.seq, array(x.pos)), 'lo', if(s.k = 0, x.top, least(s.lo, x.top)), 'hi', if(s.k = 0, x.top, greatest(s.hi, x.top)), 'out', s.out)
        else named_struct('k', 0, 'seq', cast(array() as array<int>), 'lo', 0, 'hi', 0, 'out', if(greatest(s.hi, x.top) - least(s.lo, x.top) <= %d, concat(s.out, array(concat(s.seq, array(x.pos)))), s.out)) end, s -> s.out)""" % MOST_SPAN
    runs = rows.select(*HIT, F.posexplode(F.expr(fold)).alias("run", "seq"))
    return _by_line(runs.select(*HIT, "run", F.explode("seq").alias("pos")), words, line_table, "1b")


def _line_starts(words: DataFrame) -> DataFrame:
    """Words with letters, their number k in the line, and the first four letters from there on (head)."""
    line = Window.partitionBy(*KEY, "line_id").orderBy("pos")
    kept = with_chars(words).where("norm != ''").withColumn("k", F.row_number().over(line))
    return kept.withColumn("head", F.substring(F.concat("norm", *(F.coalesce(F.lead("norm", i).over(line), F.lit("")) for i in (1, 2, 3))), 1, 4))


def respaced(words: DataFrame, line_table: DataFrame, literals: DataFrame, found: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Way 1c: words of one line that join to the literal's letters, or one word that begins with them; in lines not hit yet.

    A start is found by an equi-join on the first four letters of what follows it in the line.
    """
    head = F.substring("joined", 1, 4) if kept is None else F.translate(F.substring("joined", 1, 4), "ς", "σ")  # as places.folded has it
    kept = _line_starts(words) if kept is None else kept
    wanted = literals.where("char_length(joined) >= 4").withColumn("head", head).select("client_id", "entity", "joined", "n", "head")
    rows = kept.join(wanted, ["client_id", "head"]).join(found.select(*HIT, "line_id").distinct(), [*HIT, "line_id"], "left_anti")
    # a word has a letter at least, so as many words as the literal has letters are enough; they are looked up by place
    places = rows.select(*KEY, "line_id", "entity", F.col("k").alias("start"), F.explode(F.sequence("k", F.col("k") + F.char_length("joined"))).alias("k"))
    ahead = places.join(kept.select(*KEY, "line_id", "k", "norm", "pos"), [*KEY, "line_id", "k"]).groupBy(*KEY, "line_id", "entity", F.col("start").alias("k"))
    rows = rows.join(ahead.agg(F.array_sort(F.collect_list(F.struct("k", "norm", "pos"))).alias("ahead")), [*KEY, "line_id", "entity", "k"])
    fold = "aggregate(ahead, named_struct('acc', '', 'k', 0, 'end', -1), (s, x) -> if(s.end >= 0 or char_length(s.acc) >= char_length(joined), s, named_struct('acc', concat(s.acc, x.norm), 'k', s.k + 1, 'end', if(concat(s.acc, x.norm) = joined, x.pos, -1))))"
    rows = rows.withColumn("f", F.expr(fold))
    whole = rows.where("f.end >= 0 and not (f.k = 1 and n = 1)")
    runs = whole.select(*HIT, F.col("pos").alias("run"), F.explode(F.expr("filter(transform(slice(ahead, 1, f.k), x -> x.pos), p -> p <= f.end)")).alias("pos"))
    first = _by_line(runs, words, line_table, "1c")
    begins = rows.where("f.end < 0 and f.k = 1 and startswith(norm, joined) and norm != joined")
    second = begins.select(*HIT, F.lit("1c").alias("strategy"), "line_id", char_left("0").cast("double").alias("left"), F.col("top").cast("double").alias("top"), char_right("char_length(joined) - 1").cast("double").alias("right"), F.col("bottom").cast("double").alias("bottom"), F.lit(True).alias("partial"), F.col("text").alias("full_text"), F.col("pos").cast("int").alias("at"))
    return first.unionByName(second)


def inside_words(words: DataFrame, literals: DataFrame) -> DataFrame:
    """Way 2: the literal inside a longer word at its first place there, with no letter or digit on either side."""
    rows = with_chars(words).withColumn("low", F.lower("text")).where("low rlike '[^\\\\p{L}\\\\p{N}]'")
    # between signs: the literal begins at one of the word's pieces, so pieces are the join key
    pieces = rows.withColumn("piece", F.explode(F.array_distinct(F.concat(F.split("low", r"[^\p{L}\p{N}]+"), F.array("low")))))
    wanted = literals.withColumn("needle", F.lower("entity")).where(~F.col("needle").rlike(r"\s")).withColumn("piece", F.regexp_extract("needle", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]*)", 1)).select("client_id", "entity", "needle", "piece")
    hit = pieces.join(wanted, ["client_id", "piece"]).where("low != needle").withColumn("at", F.instr("low", F.col("needle")) - 1).where("at >= 0")
    before = F.expr("at = 0 or not substring(low, at, 1) rlike '[\\\\p{L}\\\\p{N}]'")
    after = F.expr("not substring(low, at + 1 + char_length(needle), 1) rlike '[\\\\p{L}\\\\p{N}]'")
    rows = hit.where(before & after).select(*HIT, F.lit("2").alias("strategy"), "line_id", char_left("at").cast("double").alias("left"), F.col("top").cast("double").alias("top"), char_right("at + char_length(needle) - 1").cast("double").alias("right"), F.col("bottom").cast("double").alias("bottom"), F.lit(True).alias("partial"), F.col("text").alias("full_text"), F.col("pos").cast("int").alias("at"))
    return rows.distinct()


def held(texts: DataFrame, key: list[str], literals: DataFrame) -> DataFrame:
    """texts(key, low, ...) with entity and needle of each literal of their client that low holds.

    A client's literals stand in one list that its texts are held against in a single pass. Where a client has more than
    MOST_LISTED, places are found by keys instead: the first four letters of a literal and every four letters in a row
    of a text; literals of fewer letters are joined by client alone.
    """
    wanted = literals.select("client_id", "entity", F.lower("entity").alias("needle"))
    many = wanted.groupBy("client_id").agg((F.count("*") > MOST_LISTED).alias("many"))
    wanted = wanted.join(many, "client_id")
    lists = wanted.where("not many").groupBy("client_id").agg(F.collect_list(F.struct("entity", "needle")).alias("lits"))
    rows = texts.join(lists, "client_id").withColumn("held_literal", F.explode(F.filter("lits", lambda x: F.contains(F.col("low"), x["needle"])))).select(*texts.columns, F.col("held_literal.entity").alias("entity"), F.col("held_literal.needle").alias("needle"))
    if not many.where("many").isEmpty():
        keyed = wanted.where("many").drop("many")
        long, short = keyed.where("char_length(needle) >= 4").withColumn("gram", F.substring("needle", 1, 4)), keyed.where("char_length(needle) < 4")
        grams = texts.where("char_length(low) >= 4").join(many.where("many").select("client_id"), "client_id").withColumn("gram", F.explode(F.expr("array_distinct(transform(sequence(1, char_length(low) - 3), i -> substring(low, i, 4)))"))).select(*key, "gram")
        keys = grams.join(long, ["client_id", "gram"]).select(*key, "entity", "needle").distinct()
        more = keys.join(texts, key).select(*rows.columns).unionByName(texts.join(short, "client_id").select(*rows.columns))
        rows = rows.unionByName(more.where(F.contains("low", "needle")))
    return rows


def inside_lines(line_table: DataFrame, literals: DataFrame, found: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Way 3: the literal anywhere in a line's content, letters around it or not; in lines not hit yet. The box is the line's."""
    line = line_table.select(*KEY, "line_id", "content", "left", "top", "right", "bottom", F.lower("content").alias("low"))
    rows = held(line, [*KEY, "line_id"], literals) if pairs is None else line.join(pairs, [*KEY, "line_id"]).where(F.contains("low", "needle"))
    rows = rows.join(found.select(*HIT, "line_id").distinct(), [*HIT, "line_id"], "left_anti")
    return rows.select(*HIT, F.lit("3").alias("strategy"), "line_id", *(F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")), F.lit(True).alias("partial"), F.col("content").alias("full_text"), F.lit(0).alias("at"))


def across_lines(line_table: DataFrame, literals: DataFrame, found: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Way 4: in a page's trimmed lines joined by spaces; every line that a place touches. Only where nothing else was found."""
    rows = line_table.where("trim(content) != ''").select(*KEY, "line_id", "left", "top", "right", "bottom", "content")
    one = F.array_sort(F.collect_list(F.struct(F.bround("top").alias("row"), F.bround("left").alias("column"), "line_id", F.trim("content").alias("c"), *(F.col(x).cast("double").alias(x) for x in ("left", "top", "right", "bottom")), "content")))
    page = rows.groupBy(*KEY).agg(one.alias("l")).withColumn("low", F.lower(F.array_join(F.transform("l", lambda x: x["c"]), " ")))
    if pairs is None:
        pairs = held(page, KEY, literals.where("instr(entity, ' ') > 0"))
    else:
        pairs = page.join(pairs, KEY).where(F.contains("low", "needle"))
    pairs = pairs.withColumnRenamed("low", "text").join(found.select(*HIT).distinct(), HIT, "left_anti")
    starts = F.expr("aggregate(slice(split(text, concat('\\\\Q', needle, '\\\\E'), -1), 1, size(split(text, concat('\\\\Q', needle, '\\\\E'), -1)) - 1), named_struct('at', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + char_length(x) + char_length(needle), 'out', concat(s.out, array(s.at + char_length(x)))), s -> s.out)")
    spans = F.expr("aggregate(l, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,line_id:int,left:double,top:double,right:double,bottom:double,content:string>>)), (s, x) -> named_struct('at', s.at + char_length(x.c) + 1, 'out', concat(s.out, array(named_struct('s', s.at, 'e', s.at + char_length(x.c), 'line_id', x.line_id, 'left', x.left, 'top', x.top, 'right', x.right, 'bottom', x.bottom, 'content', x.content)))), s -> s.out)")
    hits = pairs.select(*HIT, "needle", spans.alias("spans"), F.explode(starts).alias("at"))
    touched = hits.select(*HIT, "at", F.explode(F.expr("filter(spans, x -> x.e > at and x.s < at + char_length(needle))")).alias("x"))
    return touched.select(*HIT, F.lit("4").alias("strategy"), F.col("x.line_id").alias("line_id"), F.col("x.left").alias("left"), F.col("x.top").alias("top"), F.col("x.right").alias("right"), F.col("x.bottom").alias("bottom"), F.lit(True).alias("partial"), F.col("x.content").alias("full_text"), "at")


def find_occurrences(line_table: DataFrame, word_table: DataFrame, literal_table: DataFrame) -> DataFrame:
    """All ways together: entity's occurrences with box, line, partial flag, text and the way that found them; equal boxes once."""
    words, literals = stored(flat_words(word_table)), stored(prepared(literal_table))
    ways = (
        lambda found: exact(words, literals, line_table),
        lambda found: gapped(words, line_table, literals, found),
        lambda found: respaced(words, line_table, literals, found),
        lambda found: inside_words(words, literals),
        lambda found: inside_lines(line_table, literals, found),
        lambda found: across_lines(line_table, literals, found),
    )
    return _together(ways)


def _together(ways: tuple) -> DataFrame:
    found = None
    for way in ways:  # each way's own rows are stored once
        new = stored(way(found))
        found = new if found is None else found.unionByName(new)
    first = Window.partitionBy(*HIT, "left", "top", "right", "bottom").orderBy("strategy", "at", "full_text")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*OUT)


def find_in_documents(docs: DataFrame, literal_table: DataFrame) -> DataFrame:
    """find_occurrences in the layout of whole documents (doc_id, text, source): only words and lines that may match leave their document's row."""
    literals = stored(prepared(literal_table))
    places = stored(word_places(docs, Marks(literals.select("entity", F.col("targets").alias("words"), "joined"))))
    words = places.where("kind = 'w'").drop("kind").withColumn("norm", normalized(F.col("text")))
    line_table, kept = lines_of(places), with_chars(words).where("norm != ''")
    gram = F.udf(lambda x: longest(folded(x)), "string")
    wanted = literals.select("client_id", "entity", F.lower("entity").alias("needle"), gram("entity").alias("head"))
    held_ = places.where("kind = 'g'").select(*KEY, "line_id", "head").join(wanted, ["client_id", "head"])

    def left_over(key: list[str], found: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.select(*key, "entity", "needle").distinct().join(found.select(*key, "entity").distinct(), [*key, "entity"], "left_anti")

    return _together((
        lambda found: exact(words, literals, line_table),
        lambda found: gapped(words, line_table, literals, found),
        lambda found: respaced(words, line_table, literals, found, kept),
        lambda found: inside_words(words, literals),
        lambda found: inside_lines(line_table, literals, found, left_over([*KEY, "line_id"], found, held_)),
        lambda found: across_lines(line_table, literals, found, left_over(KEY, found, held_.where("instr(entity, ' ') > 0"))),
    ))


def viewer_words(words: DataFrame) -> DataFrame:
    """Words as the viewer's matcher knows them: without signs and typographic apostrophes at their ends; words of signs alone are left out."""
    kept = words.withColumn("norm", F.lower(F.btrim("text", F.lit(VIEWER_STRIP)))).where("norm != ''")
    order = Window.partitionBy(*KEY).orderBy("pos")
    return kept.withColumn("pos", F.row_number().over(order) - 1)


def viewer_exact(word_table: DataFrame, line_table: DataFrame, literal_table: DataFrame) -> DataFrame:
    """The viewer's way of matching whole words: as way 1, but overlapping runs count, a box goes to its line's edge where the
    line's first or last word is in it, and a literal with hyphens that is found nowhere in the client's document is
    tried again with its hyphens as word ends."""
    edges = word_table.groupBy(*KEY, "line_id").agg(F.min("word_index").alias("lo"), F.max("word_index").alias("hi"))
    words = stored(viewer_words(flat_words(word_table)).join(edges, [*KEY, "line_id"]))
    return _viewer(words, line_table, *_viewer_targets(literal_table))


def viewer_in_documents(docs: DataFrame, literal_table: DataFrame) -> DataFrame:
    """viewer_exact in the layout of whole documents (doc_id, text, source): only words that may match leave their document's row."""
    plain, again = (stored(x) for x in _viewer_targets(stored(literal_table.select("client_id", "entity"))))
    marks = Marks(plain.unionByName(again).select("entity", F.col("targets").alias("words"), F.lit(None).cast("string").alias("joined")), viewer=True)
    places = stored(word_places(docs, marks))
    words = places.where("kind = 'w'").withColumn("norm", F.lower(F.btrim("text", F.lit(VIEWER_STRIP)))).where("norm != ''")
    words = words.withColumns({"lo": F.lit(0), "hi": F.col("line_words") - 1}).drop("kind", "k", "head")
    return _viewer(words, lines_of(places), plain, again)


def _viewer_targets(literal_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """client_id, entity, targets of literals, and of those with hyphens with these as word ends."""
    targets = F.filter(F.transform(F.split(F.trim("entity"), r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(VIEWER_STRIP)))), lambda w: w != "")
    plain = literal_table.select("client_id", F.trim("entity").alias("entity")).distinct().withColumn("targets", targets).where("size(targets) > 0")
    apart = F.flatten(F.transform("targets", lambda w: F.when(F.contains(w, F.lit("-")) & ~w.rlike("^-|--|-$"), F.split(w, "-")).otherwise(F.array(w))))
    again = plain.withColumn("apart", apart).where("size(apart) > size(targets)").select("client_id", "entity", F.col("apart").alias("targets"))
    return plain, again


def _viewer(words: DataFrame, line_table: DataFrame, plain: DataFrame, again: DataFrame) -> DataFrame:
    found = stored(_viewer_runs(words, line_table, plain))
    key = ["client_id", "doc_id", "entity"]
    return found.unionByName(_viewer_runs(words, line_table, again).join(found.select(*key).distinct(), key, "left_anti"))


def _viewer_runs(words: DataFrame, line_table: DataFrame, literals: DataFrame) -> DataFrame:
    keyed = literals.withColumn("n", F.size("targets"))
    hit = words.select(*KEY, "pos", "norm").join(keyed.withColumn("norm", F.element_at("targets", 1)), ["client_id", "norm"])
    places = hit.select(*HIT, "n", F.col("pos").alias("run"), F.posexplode("targets").alias("j", "norm")).withColumn("pos", F.col("run") + F.col("j"))
    met = places.join(words, [*KEY, "pos", "norm"])
    whole = met.groupBy(*HIT, "run").agg(F.count("*").alias("k"), F.first("n").alias("n")).where("k = n").select(*HIT, "run")
    rows = met.join(whole, [*HIT, "run"]).groupBy(*HIT, "run", "line_id").agg(F.min("word_index").alias("a"), F.max("word_index").alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("left").alias("left"), F.max("right").alias("right"))
    boxed = rows.join(line_boxes(line_table), [*KEY, "line_id"])
    return boxed.select(*HIT, "line_id", F.when(F.col("a") == F.col("lo"), F.col("l_left")).otherwise(F.col("left")).cast("double").alias("left"), F.col("l_top").cast("double").alias("top"), F.when(F.col("b") == F.col("hi"), F.col("l_right")).otherwise(F.col("right")).cast("double").alias("right"), F.col("l_bottom").cast("double").alias("bottom"))
