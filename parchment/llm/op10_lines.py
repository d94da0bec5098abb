"""Line deduplication within an edit bound, by a deletion-neighbourhood join; DataFrame functions only.

A line goes if an earlier one (by doc_id, then line number) is equal or, for lines of at least `MIN_CHARS`
characters, within one edit (a character put in, left out or replaced). Every variant of a line with at most
one character deleted is emitted as a hashed key; lines within one edit share such a key: with the place of the
deletion for a replaced character, otherwise with the longer line's variant equal to the shorter line itself.
So a key needs only its earliest line, and no pairs within a key are formed. Levenshtein distance verifies.

Only lines that can have a partner emit variants: one edit changes the length by one at most and leaves either
the first or the last `EDGE` characters as they are (the first or last half of a short line), so lines whose
edges no other line of about that length has are passed over. What is left is filtered again in the same way
by all but one of `SEGMENTS` segments of a line, as one edit leaves all but one alone. No pair is lost by either.

Defined results: lines are parted by line feeds; blank lines stay; a null text is an empty one and stays; rows
equal in doc_id and text are one document, and what stays in one stays in all; rows that differ only in text go
by line number, then by a hash of the text; a row with a null doc_id comes before all others. Case and white space count. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bundled, cut, stored, table

MIN_CHARS = 16
EDGE = 24  # characters; of lines shorter than twice that, MIN_CHARS / 2
SEGMENTS = 16


def _hash(c):
    """128 bits of a string, as two numbers."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, line, h, g): each line with its place and two hashes; t tells rows of a doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    h, g = _hash(F.col("line"))
    return rows.withColumns({"h": h, "g": g})


def _blank(c):
    return F.ltrim(c, F.lit(" \t\r\f\v")) == ""


def _edges(line, n, min_chars: int):
    """Keys of both edges, for the line's own length and the one below; longer lines by one share a key."""
    edge = lambda m: F.when(m >= 2 * EDGE + 2, EDGE).otherwise(min_chars // 2)
    key = lambda m, left: F.xxhash64(F.lit(left), m, F.left(line, edge(m)) if left else F.right(line, edge(m)))
    return F.array(*[key(m, left) for m in (n, n - 1) for left in (True, False)])


def _segments(line, n):
    """Keys of the line without one of its segments, for its own length and the one below."""
    key = lambda m, i: F.xxhash64(F.lit(i), m, F.left(line, F.floor(m * i / SEGMENTS).cast("int")), F.right(line, (m - F.floor(m * (i + 1) / SEGMENTS)).cast("int")))
    return F.array(*[key(m, i) for m in (n, n - 1) for i in range(SEGMENTS)])


def _partnered(keyed: DataFrame) -> DataFrame:
    """(h): those in keyed(h, key) with a key that another h has."""
    shared = _sized(cut(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key")))
    return _sized(cut(keyed.join(shared, "key", "left_semi").select("h").distinct()))


def first_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(firsts, gone): each distinct line that isn't blank with its first place, and the hashes of those that go even there."""
    lines = lines_of(docs).where(~_blank(F.col("line")))
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos", "t")).alias("first"))
    long_ = lines.select("h", "g", "line", F.length("line").alias("n")).where(F.col("n") >= min_chars)
    long_ = long_.withColumn("keys", _edges(F.col("line"), F.col("n"), min_chars))
    keyed = long_.select("h", F.explode("keys").alias("key"))
    able = _partnered(keyed)
    texts = long_.select("h", "g", "line").join(able, "h", "left_semi").groupBy("h", "g").agg(F.first("line").alias("line"))
    texts = cut(texts.withColumn("n", F.length("line")))
    able = _partnered(texts.select("h", F.explode(_segments(F.col("line"), F.col("n"))).alias("key")))
    firsts = stored(firsts)
    texts = cut(texts.join(able, "h", "left_semi").join(firsts, ["h", "g"]))
    return firsts, near(texts)


def near(texts: DataFrame) -> DataFrame:
    """(h, g) of those lines in texts(h, g, first, line, n) that have an earlier one within one edit."""
    # lines are numbered by h here; two lines of one h are told apart when the distance is verified
    chars = texts.repartition("h").select("h", "n", F.posexplode(F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0))).alias("i", "char"))
    chars = chars.select("h", "n", "i", F.xxhash64("char", "i").alias("here"), F.xxhash64("char", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("h").orderBy("i")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.bit_xor("here").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.bit_xor("moved").over(line.rowsBetween(Window.unboundedPreceding, 0))
    # the tail after i is the whole, less what lies up to i
    rows = chars.select("h", "n", "i", F.bit_xor("here").over(whole).alias("own"), before.bitwiseXOR(F.bit_xor("moved").over(whole)).bitwiseXOR(upto).alias("key"))
    rows = stored(rows)
    place = texts.select("h", "first")
    # equal but for the character at one place: all who share the key and the place, and the earliest of them
    group = cut(rows.groupBy("key", "n", "i").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key", "n", "i"))
    alike = cut(rows.join(_sized(group), ["key", "n", "i"]).select("key", "n", "i", "h").join(_sized(place), "h"))
    least = alike.groupBy("key", "n", "i").agg(F.min("first").alias("least"))
    swapped = alike.join(least, ["key", "n", "i"]).where("least < first").select("h", "least")
    # one line is another's variant
    own = rows.where("i = 0").select(F.col("h").alias("wh"), (F.col("n") + 1).alias("n"), F.col("own").alias("key"))
    met = cut(rows.select("h", "n", "key").join(_sized(own), ["key", "n"]).select("h", "wh").distinct())
    met = met.join(_sized(place), "h").join(_sized(place.select(F.col("h").alias("wh"), F.col("first").alias("wf"))), "wh")
    longer = met.where("wf < first").select("h", F.col("wf").alias("least"))
    shorter = met.where("first < wf").groupBy(F.col("wh").alias("h")).agg(F.min("first").alias("least"))
    pairs = swapped.union(longer).union(shorter).distinct()
    both = pairs.join(texts.select("h", "g", "line"), "h").join(texts.select(F.col("first").alias("least"), F.col("line").alias("other")), "least")
    return cut(both.where(F.levenshtein("line", "other", 1).between(0, 1)).select("h", "g").distinct())


def _sized(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows it small."""
    return F.broadcast(df) if df.limit(BROADCAST_KEYS // 4 + 1).count() <= BROADCAST_KEYS // 4 else df


def cleaned(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, text, n, marks): docs' rows and texts, how many lines stay, blank ones aside (null: none), and a byte of 1 at the number of each."""
    firsts, gone = first_lines(docs, min_chars)
    stays = firsts.join(gone, ["h", "g"], "left_anti").select("first.doc_id", "first.t", "first.pos")
    at = F.sort_array(F.collect_list("pos"))  # of one text's lines
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    marks = F.array_join(F.zip_with(at, before, lambda x, y: F.concat(F.repeat(F.lit("0"), x - y - 1), F.lit("1"))), "")
    per = cut(stays.groupBy("doc_id", "t").agg(F.count("*").alias("n"), marks.cast("binary").alias("marks")))
    keyed = bundled(docs, id=F.col("doc_id").cast("long"), t=F.xxhash64("text"), text=F.col("text")).alias("d")
    on = F.col("d.id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.t") == F.col("p.t"))
    return keyed.join(per.alias("p"), on, "left").select("row", "text", "n", "marks")


def _text():
    """The text of the lines that stay; a line's mark is found by its number, whatever the number of lines."""
    line = F.split(F.col("text"), "\n", -1)
    return F.array_join(F.filter(line, lambda x, i: _blank(x) | F.coalesce(F.substr(F.col("marks"), i + 1, F.lit(1)) == F.lit("1").cast("binary"), F.lit(False))), "\n")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines that stay as text (and n_chars anew); a text of which no line stays goes, one that was blank doesn't."""
    new = cleaned(docs, min_chars).withColumn("new", F.when(F.col("text").isNotNull(), _text()))
    was_blank = ~F.exists(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: ~_blank(x))
    new = new.where(F.col("n").isNotNull() | was_blank)
    out = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return new.select(*[(out[c] if c in out else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("clean", _text())
    lines = F.split(F.col("text"), "\n", -1)
    left = F.size(F.filter(lines, lambda x: _blank(x))) + F.coalesce("n", F.lit(0))
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), left.cast("long").alias("n_kept"), F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"))
