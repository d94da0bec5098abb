"""Clean pages to sections, sentences and chunks. Everything stays in the JVM; a document is the unit of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import nearby, once, once_each

#: Categories that subsections take from their section; the section before the first heading.
STRONG = ["exclusions", "waiting_period", "claims", "renewal", "definitions"]
FIRST = ("Preamble", "general")
TITLE, CHUNK, OVERLAP, LEAST = 90, 1000, 150, 25


def opened(heads: Column) -> Column:
    """array<struct<at, title, cat>>: which of heads, a document's lines that look like headings, open a section.

    A numbered line is an item of a list where numbers would go back, skip more than one section, or name no
    known category; capitals excepted. SECTION and PART begin a new numbering. Only lines that look like
    headings take part, so the fold is over a few lines of each document.
    """
    found = "array<struct<at:int,title:string,cat:string>>"
    start = F.struct(F.lit(None).cast("int").alias("n"), F.lit(FIRST[1]).alias("cat"), F.create_map().cast("map<string,string>").alias("parents"), F.array().cast(found).alias("out"))

    def step(s, h):
        numbered = F.coalesce(h["kind"] == "n", F.lit(False))
        item = numbered & s["n"].isNotNull() & ~h["upper"] & ((h["n"] < s["n"]) | ((h["depth"] == 1) & ((h["n"] > s["n"] + 2) | h["cat"].isNull())))
        key = F.concat_ws(":", h["kind"], h["top"])
        above = F.try_element_at(s["parents"], key)
        inherits = h["kind"].isNotNull() & (h["depth"] > 1) & above.isin(STRONG) & ~h["coded"]
        cat = F.coalesce(F.when(F.coalesce(inherits, F.lit(False)), above), h["cat"], s["cat"])
        top = h["kind"].isNotNull() & (h["depth"] == 1)
        parents = F.map_concat(F.map_filter(s["parents"], lambda k, _: k != key), F.create_map(key, F.coalesce(h["cat"], s["cat"])))
        n = F.when(numbered, h["n"]).when(~h["restart"], s["n"])
        opens = F.struct(n.alias("n"), cat.alias("cat"), F.when(F.coalesce(top, F.lit(False)), parents).otherwise(s["parents"]).alias("parents"), F.concat(s["out"], F.array(F.struct(h["at"].alias("at"), h["title"].alias("title"), cat.alias("cat")))).alias("out"))
        return F.when(F.coalesce(item, F.lit(False)), s).otherwise(opens)

    return F.aggregate(heads, start, step)["out"]


def _head(line: Column) -> Column:
    """What the fold needs of a line that looks like a heading, else null."""
    made = lambda at: F.struct(
        F.left(line, F.lit(TITLE)).alias("title"), at["kind"].alias("kind"), at["top"].alias("top"), at["top"].try_cast("int").alias("n"), at["depth"].alias("depth"),
        T.category(line).alias("cat"), T.upper_case(line).alias("upper"), line.rlike(r"(?i)^\s*(section|part)\s+[a-z0-9]+\b").alias("restart"), line.rlike(r"(?i)excl\s?-?\s?\d").alias("coded"),
    )
    return F.when(T.heading(line), once(T.section_number(line), made))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line) of clean pages."""
    rows = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return rows.where("line IS NOT NULL")


def sectioned(rows: DataFrame, repeating: bool = False) -> DataFrame:
    """Lines with block (0 before the first heading), first (of its block), title and category; repeating: lines that many documents share are looked at once.

    A document's lines come together in order once; its sections are parts of that list.
    """
    rows = once_each(rows, ["line"], "h", lambda x: _head(x["line"])) if repeating else rows.withColumn("h", _head(F.col("line")))
    docs = rows.select("doc_id", F.struct("page", "line_no", "line", "h").alias("l")).groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("at"), x["h"].alias("h"))), lambda x: x["h"].isNotNull())
    heads = F.transform(heads, lambda x: x["h"].withField("at", x["at"]))
    start = F.struct(F.lit(0).alias("at"), F.lit(FIRST[0]).alias("title"), F.lit(FIRST[1]).alias("cat"))
    parts = docs.select("doc_id", "l", F.concat(F.array(start), opened(heads)).alias("s")).select("doc_id", "l", "s", F.posexplode("s").alias("block", "o"))
    end = F.coalesce(F.get("s", F.col("block") + 1)["at"], F.size("l"))
    parts = parts.select("doc_id", "block", "o", F.posexplode(F.slice("l", F.col("o.at") + 1, end - F.col("o.at"))).alias("i", "x"))
    return parts.select("doc_id", "x.page", "x.line_no", "x.line", F.col("block").cast("long").alias("block"), (F.col("i") == 0).alias("first"), "o.title", F.col("o.cat").alias("category"))


def sentences(lines: DataFrame, repeating: bool = False) -> DataFrame:
    """(doc_id, ord, text, low, page, heading, cat, title) of sectioned lines; a heading's line stands alone. repeating: as in sectioned()."""
    alone = F.col("first") & (F.col("line") == F.col("title"))
    paragraphs = lines.withColumn("part", F.when(alone, 0).otherwise(1)).groupBy("doc_id", "block", "page", "part").agg(
        F.first("title").alias("title"), F.first("category").alias("cat"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("body"))
    paragraphs = once_each(nearby(paragraphs), ["body"], "said", lambda x: _said(x["body"])) if repeating else paragraphs.withColumn("said", _said(F.col("body")))
    rows = paragraphs.select("doc_id", "block", "page", "part", "title", "cat", F.posexplode("said").alias("pos", "s")).select("*", "s.text", "s.plain").drop("s")
    same = F.col("text") == F.col("title")
    order = Window.partitionBy("doc_id").orderBy("block", "page", "part", "pos")
    low = F.lower(F.when(same, F.col("text")).otherwise(F.concat("title", F.lit(" :: "), "text")))
    return rows.select("doc_id", F.row_number().over(order).alias("ord"), "text", low.alias("low"), "page", (same & F.col("plain")).alias("heading"), "cat", "title")


def _said(body: Column) -> Column:
    """Sentences of more than eight signs, and whether one that is a title is only that: few words and no period or share."""
    plain = lambda s: (T.word_count(s) < 8) & ~F.lower(s).rlike(r"\d+\s*(months|days|years|%)")
    return F.transform(F.filter(T.sentences(body), lambda s: F.length(s) > 8), lambda s: F.struct(s.alias("text"), plain(s).alias("plain")))


def chunks(lines: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, text, page_start, page_end, title, category): lines of a section until size characters.

    The next chunk begins with the whole lines at the end that make overlap characters. Bodies of 25 characters
    or fewer are left out; chunks are numbered from 1 in each document.
    """
    by = ["doc_id", "block"]
    rows = lines.withColumn("cum", F.sum(F.length("line")).over(Window.partitionBy(*by).orderBy("page", "line_no")))
    back = Window.partitionBy(*by).orderBy("cum").rangeBetween(Window.unboundedPreceding, -overlap)
    rows = rows.withColumns({"tail": F.count("*").over(back).cast("int"), "base": F.coalesce(F.max("cum").over(back), F.lit(0))})
    whole = rows.groupBy(*by, "title", "category").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "line", "cum", "tail", "base"))).alias("l"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("length"), F.array().cast("array<struct<s:int,e:int>>").alias("cuts"))
    last = F.size("l") - 1

    def step(s, x):
        length = s["length"] + F.length(x["line"]) + 1
        later = x["tail"] > s["start"]
        begin, base = F.when(later, x["tail"]).otherwise(s["start"]), F.when(later, x["base"]).otherwise(s["base"])
        made = F.struct((s["i"] + 1).alias("i"), begin.alias("start"), base.alias("base"), (x["cum"] - base).alias("length"), F.concat(s["cuts"], F.array(F.struct(s["start"].alias("s"), s["i"].alias("e")))).alias("cuts"))
        more = F.struct((s["i"] + 1).alias("i"), s["start"].alias("start"), s["base"].alias("base"), length.alias("length"), s["cuts"].alias("cuts"))
        return F.when((length >= size) | (s["i"] == last), made).otherwise(more)

    cut = whole.select(*by, "title", "category", "l", F.posexplode(F.aggregate("l", start, step)["cuts"]).alias("k", "c"))
    part = F.slice("l", F.col("c.s") + 1, F.col("c.e") - F.col("c.s") + 1)
    cut = cut.select(*by, "k", "title", "category", F.transform(part, lambda x: x["line"]).alias("t"), F.get("l", "c.s")["page"].alias("page_start"), F.get("l", "c.e")["page"].alias("page_end"))
    cut = cut.withColumn("body", F.array_join("t", "\n")).where(F.length(T.strip(F.col("body"))) > LEAST)
    text = F.when(F.startswith("body", "title"), F.col("body")).otherwise(F.concat(F.lit("["), "title", F.lit("]\n"), "body"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "k"))
    return cut.select("doc_id", n.alias("chunk"), text.alias("text"), "page_start", "page_end", "title", "category")


def citation(name, page_start, page_end, title):
    """name, p.a or pp.a-b, and the section."""
    pages = F.when(page_start == page_end, F.concat(F.lit("p."), page_start)).otherwise(F.concat(F.lit("pp."), page_start, F.lit("-"), page_end))
    return F.concat(name, F.lit(", "), pages, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(", § "), title)).otherwise(""))
