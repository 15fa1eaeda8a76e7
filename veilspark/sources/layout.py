"""Layout tables from documents (lines, words, pages) and to and from nested layout JSON.

Texts have no glyph geometry, so it is synthesized: 6 points a character, 12 a line, 50 lines a page. Integers keep all
boxes exact. A client is a source, a document its id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_A_PAGE = 50
LINE_HEIGHT = 12
CHAR_WIDTH = 6
MARGIN = 50
KEY = ["client_id", "doc_id", "page"]


def lines(docs: DataFrame) -> DataFrame:
    """client_id, doc_id, page, line_id, content, box, is_ghost, rotation."""
    rows = docs.select(F.col("source").alias("client_id"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "content"))
    line = F.col("i") % LINES_A_PAGE
    return rows.select("client_id", "doc_id", (F.floor(F.col("i") / LINES_A_PAGE) + 1).cast("int").alias("page"), line.alias("line_id"), "content", F.lit(MARGIN).alias("left"), (MARGIN + LINE_HEIGHT * line).alias("top"), (MARGIN + CHAR_WIDTH * F.char_length("content")).alias("right"), (MARGIN + LINE_HEIGHT * (line + 1)).alias("bottom"), F.lit(False).alias("is_ghost"), F.lit(0).alias("rotation"))


WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of lines (content last): the other columns of a word's line, word_index, text, and its first and last offset."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            found = [[(m.start(), m.end(), m.group()) for m in WORD.finditer(x or "")] for x in part.column(part.num_columns - 1).to_pylist()]
            counts = np.array([len(x) for x in found])
            row = np.repeat(np.arange(len(found)), counts)
            flat = [x for words_ in found for x in words_]
            columns = [c.take(pa.array(row)) for c in part.columns[:-1]]
            columns.append(pa.array((np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)))
            columns += [pa.array([x[2] for x in flat], pa.string()), *(pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "word_index", "text", "start", "end"])


def words(line_table: DataFrame) -> DataFrame:
    """One row per word of a line: word_index, id 'line.word', text, box. Words are cut in Arrow batches: linear in the text, and nothing is shuffled."""
    rows = line_table.select(*KEY, "line_id", "top", "bottom", "content")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "content")
    rows = rows.mapInArrow(_word_rows, f"{kinds}, word_index int, text string, start int, end int")
    return rows.select(*KEY, "line_id", "word_index", F.concat_ws(".", "line_id", "word_index").alias("id"), "text", (MARGIN + CHAR_WIDTH * F.col("start")).alias("left"), (MARGIN + CHAR_WIDTH * F.col("end")).alias("right"), "top", "bottom")


def page_rows(docs: DataFrame) -> DataFrame:
    """client_id, doc_id, page and its lines as an array (line_id, content, box), as in `lines`. A document's lines stay in its row: nothing is shuffled."""
    rows = docs.select(F.col("source").alias("client_id"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    rows = rows.select("client_id", "doc_id", "l", F.explode(F.expr(f"sequence(0, int((size(l) - 1) div {LINES_A_PAGE}))")).alias("p"))
    line = "named_struct('line_id', i, 'content', c, 'left', {0}, 'top', {0} + {1} * i, 'right', {0} + {2} * char_length(c), 'bottom', {0} + {1} * (i + 1))".format(MARGIN, LINE_HEIGHT, CHAR_WIDTH)
    return rows.select("client_id", "doc_id", (F.col("p") + 1).alias("page"), F.expr(f"transform(slice(l, p * {LINES_A_PAGE} + 1, {LINES_A_PAGE}), (c, i) -> {line})").alias("lines"))


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
MOST_BYTES = 1 << 20  # of texts that are cut at once, if it is more than one


class Cut:
    """Lines and words of some texts, as arrays. Lines: line_doc, line_no (in its text), content, line_chars. Words: word_line, word_index, text, start and end (in characters of the line)."""

    def __init__(self, texts: list[str]):
        raw = [x.encode() for x in texts]
        # a line feed after each text: it ends the text's last line, as those inside end the others
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        doc_end = np.cumsum([len(x) + 1 for x in raw]) - 1
        self.line_doc = np.searchsorted(doc_end, ends)
        first = np.searchsorted(self.line_doc, np.arange(len(raw)))
        self.line_no = np.arange(len(ends)) - first[self.line_doc]
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
        self.line_chars = before[ends] - before[starts]
        self.content = self._strings(data[data != 10], ends - starts)
        space = SPACE[data]
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        self.word_line = np.searchsorted(ends, begins)
        self.words_before = np.searchsorted(self.word_line, np.arange(len(ends) + 1))
        self.word_index = np.arange(len(begins)) - self.words_before[self.word_line]
        self.start, self.end = (before[x] - before[starts[self.word_line]] for x in (begins, stops))
        self.text = self._strings(data[~space], stops - begins)

    @staticmethod
    def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def few_at_once(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with MOST_BYTES characters in all, or of one text."""
    at = size = 0
    for i, x in enumerate(texts):
        if i > at and size + len(x) > MOST_BYTES:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, len(texts)


def _word_counts(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in few_at_once(texts):
            cut = Cut(texts[a:b])
            clients, words_ = batch.column(0).slice(a, b - a).dictionary_encode("encode"), cut.text.dictionary_encode()
            fits = np.array([re.fullmatch(pattern, x) is not None for x in words_.dictionary.to_pylist()], bool)
            word = words_.indices.to_numpy()
            at = np.flatnonzero(fits[word]) if len(word) else word
            client = clients.indices.to_numpy()[cut.line_doc[cut.word_line[at]]]
            pairs, n = np.unique(client.astype(np.int64) * max(len(fits), 1) + word[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([clients.dictionary.take(pa.array(pairs // max(len(fits), 1))), words_.dictionary.take(pa.array(pairs % max(len(fits), 1))), pa.array(n.astype(np.int64))], ["client_id", "text", "n"])


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """client_id, text, n: how often a client's documents have each word that the pattern fits as a whole; counted before anything is shuffled."""
    rows = docs.select(F.col("source").alias("client_id"), F.col("text"))
    return rows.mapInArrow(lambda batches: _word_counts(batches, pattern), "client_id string, text string, n long").groupBy("client_id", "text").agg(F.sum("n").alias("n"))


def _lists(values: pa.Array, offsets: np.ndarray, empty_is_null: bool = False) -> pa.ListArray:
    mask = pa.array(offsets[1:] == offsets[:-1]) if empty_is_null else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def _struct(**columns: np.ndarray | pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)) for x in columns.values()], list(columns))


NESTED = "doc_id {}, pages array<struct<page:int,xml_texts:array<struct<id:int,content:string,left:int,top:int,right:int,bottom:int,words:array<struct<id:string,text:string,left:int,right:int,top:int,bottom:int>>>>>>"


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and its pages of lines of words, from (doc_id, text)."""
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in few_at_once(texts):
            cut = Cut(texts[a:b])
            line_id = cut.line_no % LINES_A_PAGE
            top, in_line = MARGIN + LINE_HEIGHT * line_id, cut.word_line
            name = pc.binary_join_element_wise(pa.array(line_id[in_line]).cast(pa.string()), pa.array(cut.word_index).cast(pa.string()), ".")
            words_ = _struct(id=name, text=cut.text, left=MARGIN + CHAR_WIDTH * cut.start, right=MARGIN + CHAR_WIDTH * cut.end, top=top[in_line], bottom=top[in_line] + LINE_HEIGHT)
            left = np.full(len(line_id), MARGIN)
            lines_ = _struct(id=line_id, content=cut.content, left=left, top=top, right=left + CHAR_WIDTH * cut.line_chars, bottom=top + LINE_HEIGHT, words=_lists(words_, cut.words_before, True))
            page_at = np.flatnonzero(line_id == 0)
            pages_ = _struct(page=cut.line_no[page_at] // LINES_A_PAGE + 1, xml_texts=_lists(lines_, np.append(page_at, len(line_id))))
            doc_at = np.searchsorted(cut.line_doc[page_at], np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(pages_, doc_at)], ["doc_id", "pages"])


def chars(word_table: DataFrame) -> DataFrame:
    """One row per character of a word: even widths inside the word's box."""
    rows = word_table.select(*KEY, "line_id", "word_index", "left", "top", "bottom", F.posexplode(F.split("text", "")).alias("char_index", "char")).where("char != ''")
    return rows.select(*KEY, "line_id", "word_index", "char_index", "char", (F.col("left") + CHAR_WIDTH * F.col("char_index")).alias("left"), (F.col("left") + CHAR_WIDTH * (F.col("char_index") + 1)).alias("right"), "top", "bottom")


def split_trailing_signs(word_table: DataFrame) -> DataFrame:
    """Words without trailing . , ; : ! ? and these signs as words of their own; words of signs alone stay whole."""
    body = F.regexp_extract("text", r"^(.*?)([.,;:!?]+)$", 1)
    signs = F.regexp_extract("text", r"^(.*?)([.,;:!?]+)$", 2)
    piece = lambda text, begin: F.struct(text.alias("text"), begin.alias("begin"))
    parts = F.when((body != "") & (signs != ""), F.array(piece(body, F.lit(0)), piece(signs, F.char_length(body)))).otherwise(F.array(piece(F.col("text"), F.lit(0))))
    rows = word_table.select(*KEY, "line_id", "word_index", "left", "top", "bottom", F.posexplode(parts).alias("part", "p"))
    left = F.col("left") + CHAR_WIDTH * F.col("p.begin")
    return rows.select(*KEY, "line_id", "word_index", "part", F.col("p.text").alias("text"), left.alias("left"), (left + CHAR_WIDTH * F.char_length("p.text")).alias("right"), "top", "bottom")


def page_text(line_table: DataFrame, *, drop_ghosts: bool = True) -> DataFrame:
    """client_id, doc_id, page, text: lines in order, joined by line feeds, empty ones left out; a cell group gives its merged value once, or its first line's content where that is empty."""
    rows = line_table
    if drop_ghosts:
        rows = rows.where(~F.coalesce("is_ghost", F.lit(False)))
    content: Column = F.col("content")
    if "cell_group" in line_table.columns:
        first = F.row_number().over(Window.partitionBy(*KEY, "cell_group").orderBy("line_id"))
        rows = rows.withColumn("_n", F.when(F.col("cell_group").isNull(), 1).otherwise(first)).where("_n = 1")
        content = F.when(F.col("cell_group").isNull(), F.col("content")).otherwise(F.coalesce(F.nullif("cell_merged_value", F.lit("")), "content"))
    ordered = F.array_sort(F.collect_list(F.struct("line_id", content.alias("content"))))
    return rows.groupBy(*KEY).agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["content"]), lambda c: c != ""), "\n").alias("text"))


def full_text(line_table: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """page_text of the pages that have lines (ghosts or not), raw_pages' own text of the others; blank pages are left out."""
    ours = page_text(line_table)
    empty = line_table.select(*KEY).distinct().join(ours.select(*KEY), KEY, "left_anti").withColumn("text", F.lit(""))
    rest = raw_pages.select(*KEY, "text").join(line_table.select(*KEY).distinct(), KEY, "left_anti")
    return ours.unionByName(empty).unionByName(rest).where("trim(text) != ''")


def pages(line_table: DataFrame) -> DataFrame:
    """Page count of each document: the highest page number, gaps included."""
    return line_table.groupBy("client_id", "doc_id").agg(F.max("page").alias("total_pages"), F.count("*").alias("n_lines"), F.count_if(F.coalesce("is_ghost", F.lit(False))).alias("n_ghosts"))


LAYOUT = "struct<schema_version:string,source_filename:string,pages:map<string,struct<page_layout:struct<width:double,height:double>,xml_texts:array<struct<id:int,content:string,left:double,top:double,right:double,bottom:double,is_ghost:boolean,rotation:int,words:array<struct<id:string,text:string,left:double,right:double,top:double,bottom:double>>>>>>>"


def read_layout_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines from layout JSON files (one document a file); files without pages or that don't parse give no lines."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", LAYOUT).alias("v"))
    rows = raw.where(F.size("v.pages") > 0).select(F.coalesce("v.source_filename", "file").alias("stem"), F.explode("v.pages").alias("page", "p"))
    rows = rows.select("stem", F.col("page").try_cast("int").alias("page"), F.explode("p.xml_texts").alias("t"))
    return rows.select("stem", "page", "t.*")


def layout_json(line_table: DataFrame, word_table: DataFrame) -> DataFrame:
    """doc_id and its layout as JSON; optional keys that are null are left out."""
    grouped = word_table.groupBy("doc_id", "page", "line_id").agg(F.array_sort(F.collect_list(F.struct("word_index", "id", "text", "left", "right", "top", "bottom"))).alias("words"))
    rows = line_table.join(grouped, ["doc_id", "page", "line_id"], "left")
    text = F.struct(F.col("line_id").alias("id"), "content", "left", "top", "right", "bottom", F.when(F.col("is_ghost"), True).alias("is_ghost"), F.nullif("rotation", F.lit(0)).alias("rotation"), F.transform("words", lambda w: w.dropFields("word_index")).alias("words"))
    by_page = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(text), lambda a, b: a["id"] - b["id"]).alias("xml_texts"))
    by_doc = by_page.groupBy("doc_id").agg(F.collect_list(F.struct("page", "xml_texts")).alias("pages"))
    return _as_json(by_doc)


def documents_layout(docs: DataFrame) -> DataFrame:
    """layout_json of whole documents (doc_id, text): cut into lines and words and nested in the document's own row, so that no line or word is shuffled."""
    rows = docs.select("doc_id", "text")
    return _as_json(rows.mapInArrow(_nested, NESTED.format(rows.schema["doc_id"].dataType.simpleString())))


def _as_json(by_doc: DataFrame) -> DataFrame:
    pages_ = F.map_from_entries(F.array_sort(F.transform("pages", lambda p: F.struct(p["page"].cast("string").alias("key"), F.struct(p["xml_texts"].alias("xml_texts")).alias("value")))))
    return by_doc.select("doc_id", F.to_json(F.struct(F.lit("v4.10").alias("schema_version"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_filename"), pages_.alias("pages"))).alias("layout"))


def slim_layout(line_table: DataFrame) -> DataFrame:
    """What a viewer needs of the lines."""
    return line_table.select("doc_id", "page", F.to_json(F.struct(F.col("line_id").alias("id"), "content", "left", "top", "right", "bottom", F.when(F.col("is_ghost"), True).alias("is_ghost"), F.nullif("rotation", F.lit(0)).alias("rotation"))).alias("line"))
