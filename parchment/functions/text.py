"""Text expressions of policy documents: lines, headings, masking, sentences, guardrails. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import once

#: What is masked, in this order.
MASKS = [
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"),
    (r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)", "[PHONE]"),
    (r"\b[A-Z]{5}\d{4}[A-Z]\b", "[PAN]"),
    (r"(?<!\d)\d{4}\s?\d{4}\s?\d{4}(?!\d)", "[AADHAAR]"),
    (r"(?i)(policy\s*(?:no|number)\.?\s*[:\-]?\s*)([A-Z0-9/\-]{6,})", "$1[POLICY_NO]"),
    (r"(?i)((?:insured|proposer|policyholder)(?:'s)?\s*name\s*[:\-]\s*)([A-Za-z .]{3,40})", "$1[NAME]"),
    (r"(?i)(date of birth|dob)\s*[:\-]?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", "$1: [DOB]"),
]
#: Where masks can find anything: plain words or a pattern that some part of what they match holds, whatever the masks before them put in.
MASKED = {
    "[EMAIL]": lambda low: low.contains("@"), "[PHONE]": lambda low: low.rlike(r"\d{4}\s?\d{4}"), "[AADHAAR]": lambda low: low.rlike(r"\d{4}\s?\d{4}"),
    "$1[NAME]": lambda low: low.contains("name"), "$1: [DOB]": lambda low: low.contains("dob") | low.contains("date of birth"),
}
#: Words that place a heading in a category; the first category with a word in it wins.
CATEGORIES = [
    ("waiting_period", ["waiting period", "pre-existing", "pre existing", "excl01", "excl02", "excl03"]),
    ("exclusions", ["exclusion", "not covered", "what is not covered", "non-payable", "non payable"]),
    ("claims", ["claim", "cashless", "reimbursement", "tpa"]),
    ("renewal", ["renewal", "portability", "migration", "grace period", "cancellation", "free look", "moratorium"]),
    ("definitions", ["definition", "meaning of words", "interpretation"]),
    ("copay_limits", ["co-pay", "copay", "co-payment", "sub-limit", "sub limit", "room rent", "limits of coverage", "deductible"]),
    ("coverage", ["coverage", "benefit", "cover", "what is covered", "scope", "hospitali", "maternity", "newborn", "day care", "ambulance", "ayush", "domiciliary", "restoration", "recharge", "bonus"]),
    ("premium", ["premium", "sum insured", "schedule", "eligibility", "entry age"]),
    ("general", ["general terms", "terms and conditions", "conditions", "grievance", "ombudsman"]),
]
#: Forms of a numbered heading, of an exclusion code, of a line that is only a page number.
HEADING = r"(?i)^(section\s+[a-z0-9]+\b|part\s+[a-z0-9]+\b|[a-z]?\d{1,2}(\.\d{1,2}){0,3}[.)]?\s*[A-Za-z(]|[a-z]\.\d{1,2}(\.\d{1,2})?\s+[A-Z]|code\s*[-:]?\s*excl\s?\d+)"
CODED = r"(?i)code\s*[-:]?\s*excl\s?\d{1,2}"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,3}(\s*(of|/)\s*\d{1,3})?\s*$"
NUMBER = r"(?i)^(?:(?:section|part)\s+([a-z]|\d{1,2})\b|([a-z])\.(\d{1,2})|(\d{1,2})((?:\.\d{1,2})*)\.?)"
#: So many small letters that a line of at most 95 characters isn't one of capitals.
LOWER = r"^(?:[^a-z]*[a-z]){20}"
#: What ends like a sentence but doesn't end one.
ABBREVIATION = r"(?iU)(?:\b(?:rs|no|nos|e\.g|i\.e|viz|etc|sr|dr|mr|mrs|ms|st|vs|approx|max|min|cl|sec|art)|\b[a-z]|\d)\.$"
SENTENCE = r"(?<=[.;])\s+(?=[A-Z(\d\"'“])"
#: Questions that ask for advice, and advice that isn't given.
ADVICE = r"(?i)\b(should i|shall i|do i|must i|is it (good|better|worth)|which (one|policy) (is|should)|recommend|buy|switch|port|cancel|worth it)\b"
UNSAFE = [
    (r"(?i)\byou should (definitely )?(buy|purchase|switch|cancel|port|take)\b", "you may want to discuss with an advisor whether to"),
    (r"(?i)\b(i|we) recommend (buying|switching|cancelling|purchasing)\b", "an advisor can help you evaluate"),
    (r"(?i)\b(do not|don't) (buy|switch|cancel)\b", "carefully evaluate before you"),
    (r"(?i)\bthis is the best policy\b", "this policy appears stronger in some areas"),
]
#: Words of no weight in questions.
STOP = """the a an is are of in to for and or this that my policy does do what any there be with on under i me how can will
it its as at by from have has which when where why who benefit benefits cover covered coverage expenses insured sum person policyholder""".split()

WHITE = r"[\s   -     　\u0085\u001c-\u001f]"
#: The signs of WHITE one by one, and a run of others; signs of ASCII first, as a pattern's classes are tried in turn.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = f"[!-~{WHITE.replace('[', '[^', 1)}]+"
BREAKS = r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]"


def _each(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def dehyphenate(text: Column) -> Column:
    """Words cut at a line's end are whole again."""
    return F.when(text.contains("-\n"), F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(text)


def lines(text: Column) -> Column:
    """Lines as an array; an empty rest after the last break is none."""
    return once(F.split(text, BREAKS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def normal_line(line: Column) -> Column:
    """Bullets, dashes and quotes of one kind; runs of blanks as one."""
    signs = F.translate(line, "●▪–—’“”", "••••--'\"\"")
    return strip(F.regexp_replace(signs, "[ \t ]{2,}|[\t ]", " "))


def page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def digits_masked(line: Column) -> Column:
    return F.regexp_replace(line, r"\d+", "#")


def anonymize(text: Column) -> Column:
    def masked(s):
        def one(t, rule):
            pattern, put = rule
            return once(t, lambda x: F.when(MASKED[put](s["low"]), F.regexp_replace(x, pattern, put)).otherwise(x)) if put in MASKED else F.regexp_replace(t, pattern, put)

        return reduce(one, MASKS, s["text"])

    return once(F.struct(text.alias("text"), F.lower(text).alias("low")), masked)


def category(heading: Column) -> Column:
    low = F.lower(heading)
    code = F.regexp_extract(low, r"excl\s?-?\s?(\d{1,2})", 1)
    out = F.when(code != "", F.when(code.try_cast("int") <= 3, "waiting_period").otherwise("exclusions"))
    for name, words in CATEGORIES:
        out = out.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), name)
    return out


def _letters(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"\P{L}+", ""))


def upper_case(line: Column) -> Column:
    n = _letters(line)
    return (n >= 5) & (F.length(F.regexp_replace(line, r"\P{Lu}+", "")) > 0.8 * n)


def word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def heading(line: Column) -> Column:
    n, words = F.length(line), word_count(line)
    could = (n <= 95) & (n >= 3) & (~line.rlike(LOWER) | line.rlike(HEADING) | line.rlike(CODED))
    bare = F.rtrim(line, F.lit(BLANKS))
    shape = (n <= 95) & (n >= 3) & ~bare.rlike(r"[,;/\-&]$") & (_letters(line) >= 3)
    stop = line.rlike(r"\.$")
    late_stop = bare.rlike(r"\.$")
    return could & shape & ((upper_case(line) & (words <= 12) & ~stop) | (line.rlike(HEADING) & (words <= 12) & ~late_stop) | (line.rlike(CODED) & (words <= 14)))


def section_number(line: Column) -> Column:
    """struct(kind, top, depth): kind n for numbers and a for letters; null without a number."""
    s = strip(line)
    part = [F.regexp_extract(s, NUMBER, i) for i in range(6)]
    made = lambda kind, top, depth: F.struct(F.lit(kind).alias("kind"), top.alias("top"), depth.cast("int").alias("depth"))
    low = F.lower(part[1])
    return (
        F.when(part[1].rlike(r"^\d"), made("n", part[1].try_cast("int").cast("string"), F.lit(1)))
        .when(part[1] != "", made("a", low, F.lit(1)))
        .when(part[2] != "", made("a", F.lower(part[2]), F.lit(2)))
        .when(part[4] != "", made("n", part[4].try_cast("int").cast("string"), F.length(F.regexp_replace(part[5], r"[^.]", "")) + 1))
    )


def sentences(text: Column) -> Column:
    """Sentences as an array; a part after an abbreviation stays with it."""
    glued = F.aggregate(
        F.split(text, SENTENCE),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(
            (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1)).rlike(ABBREVIATION), F.lit(False)),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), part))),
        ).otherwise(F.concat(acc, F.array(part))),
    )
    return F.filter(F.transform(glued, strip), lambda s: s != "")


def asks_advice(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(ADVICE)


def sanitize(text: Column) -> Column:
    return _each(text, UNSAFE)


def tokens(text: Column) -> Column:
    """Distinct words of weight."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]+"), F.lit(0))), F.array(*map(F.lit, STOP)))


def rupees(number: Column, unit: Column) -> Column:
    """A number as written, with its unit (lakh, lac, crore), as whole rupees."""
    n = F.regexp_replace(number, ",", "").try_cast("decimal(20,4)")
    u = F.lower(F.coalesce(unit, F.lit("")))
    return (n * F.when(u.startswith("lakh") | u.startswith("lac"), 100_000).when(u.startswith("crore"), 10_000_000).otherwise(1)).cast("long")


def quote(text: Column, words: int = 30) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, words), " ")
