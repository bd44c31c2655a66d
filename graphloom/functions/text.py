"""Text rules as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = "các của gì hoặc là những trong từ và vào với đến".split()
CATEGORIES = (("ai", "person"), ("cái gì", "thing"), ("ở đâu", "location"), ("khi nào", "time"), ("tại sao", "reason"))
#: Unicode's White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NO_ANSWER = "[NO PREDICTION]"
NOTHING_FOUND = "No relevant information found."


def strip(x: Column) -> Column:
    """Without white space (Unicode's) at both ends; only the ends are looked at."""
    return F.btrim(x, F.lit(SPACE))


def tokens(x: Column) -> Column:
    """Runs of non-white-space, in order, repeated ones too."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def words(x: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def keywords(x: Column, most: int = 5) -> Column:
    """The first words that are longer than a character and no stop words."""
    return F.array_join(F.slice(F.filter(words(x), lambda w: (F.length(w) > 1) & ~w.isin(*STOP)), 1, most), " ")


def category(x: Column) -> Column:
    """The first category whose phrase occurs anywhere in the text; '' where none does."""
    low, out = F.lower(x), F.lit("")
    for phrase, name in reversed(CATEGORIES):
        out = F.when(F.contains(low, F.lit(phrase)), name).otherwise(out)
    return out


def sanitized(x: Column) -> Column:
    """Letters, digits, underscores, white space and hyphens only; null gives ''."""
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[^\p{L}\p{N}_\s-]", ""))


def relation_type(x: Column) -> Column:
    t = F.upper(F.regexp_replace(sanitized(x), r"(?U)[\s-]+", "_"))
    return F.when(t == "", "RELATED_TO").otherwise(t)


def property_key(x: Column) -> Column:
    return F.translate(sanitized(x), " -", "__")


def option_text(x: Column) -> Column:
    """Without a leading letter mark such as (A), A. A) A: A- or a lone A."""
    return strip(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?U)^(?:\([A-Za-z]\)|[A-Za-z][.):\-]|[A-Za-z]\s)\s*", ""))


def without_textbook(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?iu)\([^)]*(?:sách giáo khoa|sach giao khoa)[^)]*\)", ""))


def truth(x: Column) -> Column:
    t = F.upper(strip(F.coalesce(x, F.lit(""))))
    return F.when(t.isin("T", "TRUE", "Đ", "D", "1", "YES", "Y"), True).when(t.isin("F", "FALSE", "0", "N", "NO"), False).otherwise(F.startswith(t, F.lit("T")))


def answer_vector(x: Column, n: Column) -> Column:
    """Answers given as a comma list, a space list or packed letters; cut or filled with F to n."""
    t = F.upper(strip(F.coalesce(x, F.lit(""))))
    parts = F.when(F.contains(t, F.lit(",")), F.transform(F.split(t, ","), strip)).when(t.rlike(r"\s"), tokens(t)).otherwise(F.filter(F.split(t, ""), lambda c: c != ""))
    return F.slice(F.concat(parts, F.array_repeat(F.lit("F"), n)), F.lit(1), n)


def repaired_json(x: Column) -> Column:
    """Commas before a closing sign go; missing closing braces, then brackets, are appended."""
    t = F.regexp_replace(F.regexp_replace(x, r"(?U),\s*\}", "}"), r"(?U),\s*\]", "]")

    def lacking(left: str, right: str) -> Column:
        count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
        return F.repeat(F.lit(right), F.greatest(F.lit(0), count(left) - count(right)))

    return F.concat(t, lacking("{", "}"), lacking("[", "]"))


def json_span(x: Column) -> Column:
    """From the first { to the last }, without code fences; '' where there is none."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?m)^\s*```(?:json)?\s*", ""), r"(?m)\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def lettered(options: Column, most: int | None = None) -> Column:
    """A. first, B. second, ... one a line."""
    few = F.slice(options, 1, most) if most else options
    return F.array_join(F.transform(few, lambda o, k: F.concat(F.char(k + 65), F.lit(". "), o)), "\n")


def answer_letter(x: Column, true_false: bool = False) -> Column:
    """struct(letter, confidence, method) of a free answer: a lone letter, else the first letter A to D that stands alone, else (true or false) key words."""
    up, low = strip(F.upper(x)), F.lower(x)
    alone = F.regexp_extract(up, r"(?<![\p{L}\p{N}_])([ABCD])(?![\p{L}\p{N}_])", 1)
    say = lambda letter, sure, how: F.struct(letter.alias("letter"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))
    out = F.when(up.isin("A", "B", "C", "D"), say(up, 1.0, "direct_match")).when(alone != "", say(alone, 0.8, "pattern_match"))
    if true_false:
        some = lambda *ws: F.lit(False) if not ws else F.contains(low, F.lit(ws[0])) | some(*ws[1:])
        out = out.when(some("đúng", "true", "correct"), say(F.lit("A"), 0.6, "keyword_match")).when(some("sai", "false", "wrong"), say(F.lit("B"), 0.6, "keyword_match"))
    return out.otherwise(say(F.lit(NO_ANSWER), 0.0, "no_match"))


def answer_option(x: Column, options: int = 4) -> Column:
    """struct(letter, confidence): the letter after the answer mark; without that mark the first of A, B, ... that stands alone anywhere; null letter where there is none."""
    marked = F.upper(F.regexp_extract(x, r"(?iu)Đáp án\s*:\s*([ABCD])", 1))
    say = lambda letter, sure: F.struct(letter.cast("string").alias("letter"), F.lit(sure).alias("confidence"))
    allowed = [chr(65 + k) for k in range(options)]
    out = F.when(marked.isin(*allowed), say(marked, 0.8)).when(marked != "", say(F.lit(None), 0.0))
    for letter in allowed:
        out = out.when(x.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){letter}(?![\p{{L}}\p{{N}}_])"), say(F.lit(letter), 0.5))
    return out.otherwise(say(F.lit(None), 0.0))


def statement(x: Column) -> Column:
    """struct(context, statement) of a true-or-false question; without exactly one mark the question is the statement."""
    parts = F.split(x, "Phát biểu sau:", -1)
    quotes = lambda c: F.regexp_replace(c, '^"+|"+$', "")
    context = quotes(strip(F.replace(parts[0], F.lit("Đọc đoạn tư liệu sau đây:"), F.lit(""))))
    said = strip(F.replace(quotes(strip(F.get(parts, F.lit(1)))), F.lit("là đúng hay sai"), F.lit("")))
    two = F.size(parts) == 2
    return F.struct(F.when(two, context).otherwise("").alias("context"), F.when(two, said).otherwise(x).alias("statement"))


def chunks(text: Column, most: int = 1200) -> Column:
    """Ordered pieces of at most `most` characters, unless a single sentence is longer.

    Paragraphs end in an empty line; longer ones are cut into sentences, which get '. ' at their end. Units are packed one after another.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    unit = lambda t, tail: F.struct(t.alias("t"), F.lit(tail).alias("tail"))
    sentences = lambda p: F.transform(F.filter(F.transform(F.split(p, "[.!?;]+"), strip), lambda s: s != ""), lambda s: unit(s, ". "))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > most, sentences(p)).otherwise(F.array(unit(p, "\n\n")))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, u: Column) -> Column:
        over = F.length(acc["cur"]) + F.length(u["t"]) + 2 > most
        flush = over & (acc["cur"] != "")
        done = F.when(flush, F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(over, F.concat(u["t"], u["tail"])).otherwise(F.concat(acc["cur"], u["t"], u["tail"])).alias("cur"))

    finish = lambda acc: F.when(strip(acc["cur"]) != "", F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"])
    return F.aggregate(units, start, step, finish)
