"""Free-text job descriptions: sections, years, seniority, degrees, salary, requirement lines, title, company, place.

Everything is a Column expression over the text, except the section split, which is windows over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import extract_terms

#: Headings that open a section, in the order they are tried.
SECTIONS = (
    ("responsibilities", "responsibilities|duties|what you will do"),
    ("requirements", "requirements|qualifications|skills and qualifications|what you bring"),
    ("skills", "technical skills|skills required|key skills"),
    ("education", "education|educational background"),
    ("experience", "experience|professional experience"),
    ("benefits", "benefits|perks|what we offer"),
    ("nice_to_have", "nice to have|bonus points|preferred qualifications|good to have"),
    ("about_us", "about us|company overview"),
    ("job_info", "job title|company|location|about the role"),
)
#: Words that tell a seniority, in the order they are tried.
SENIORITY = (("junior", "junior|entry level"), ("mid", "mid-level|intermediate"), ("senior", "senior|lead|staff|principal|architect"), ("manager", "manager|head|director"))
#: Statements of years; a range also gives a maximum.
YEARS = (r"(\d+)\s*\+\s*years?", r"minimum of (?:at least)?\s*(\d+)\s*years?", r"(\d+)\s*years? (?:of|s(?: of)?|experience)", r"at least\s+(\d+)\s+years?")
YEARS_RANGE = r"(\d+)\s*[-–]\s*(\d+)\s*years?"
#: Degrees (whole words) and fields of study.
DEGREES = (("bachelor", r"bachelors?(?:'s)?(?: degree)?|b\.?tech|b\.?sc|b\.?e|b\.?s|ba"), ("master", r"masters?(?:'s)?(?: degree)?|m\.?tech|m\.?sc|m\.?e|m\.?s|ma"), ("phd", r"ph\.?d|doctorate"), ("mba", r"mba|master of business administration"))
FIELDS = ("computer science", "engineering", "electrical engineering", "software engineering", "information technology", "it", "data science", "mathematics", "statistics", "physics", "computer engineering", "related technical field", "relevant field")
CURRENCIES = (("USD", r"\$|usd"), ("EUR", r"€|eur"), ("GBP", r"£|gbp"), ("INR", r"₹|rs\.?|inr|lpa|lakhs?"))
#: White space, and the technical keywords looked for unless others are named.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TECHNICAL = ("Apache Kafka", "Kafka", "Apache Spark", "Spark", "Python", "JavaScript", "TypeScript", "Power BI", "Machine Learning", "Scikit-learn")
MANDATORY = r"(?i)\b(must|required|mandatory|essential|at least|minimum|expected)\b"
PREFERRED = r"(?i)\b(preferred|nice to have|plus|bonus|advantage|desirable)\b"


def _numbers(text: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group)), lambda x: x.try_cast("int"))


def min_years(text: Column) -> Column:
    """The largest of all minima stated; null if none is."""
    found = F.concat(*[_numbers(text, p, 1) for p in YEARS], _numbers(text, YEARS_RANGE, 1))
    return F.array_max(found)


def max_years(text: Column) -> Column:
    """The least of all maxima stated in ranges."""
    return F.array_min(_numbers(text, YEARS_RANGE, 2))


def seniority(text: Column) -> Column:
    """The first level whose words occur; else by the minimum years (7 or more senior, 3 mid, less junior)."""
    low = F.lower(text)
    out = None
    for level, words in SENIORITY:
        hit = low.rlike(rf"\b(?:{words})\b")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    y = min_years(text)
    return out.when(y >= 7, "senior").when(y >= 3, "mid").when(y >= 0, "junior").when(max_years(text) <= 2, "junior")


def title(text: Column) -> Column:
    """The first line that isn't blank."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x.rlike(r"\S"))
    return F.trim(F.try_element_at(lines, F.lit(1)))


def company(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?:at|bei|chez|en)\s+([A-Z][a-zA-Z&, -]+?(?:Ltd|LLC|LLP|Inc|Corp|Group|GmbH|Limited|Incorporated|Corporation))\b", 1)), F.lit(""))


def work_mode(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(remote|hybrid|on-site)\b", 1)), F.lit(""))


def salary(text: Column) -> Column:
    """Struct of min, max, currency and period of the first range; a range needs a separator or 'between … and'."""
    amount = r"(?:\$|€|£|₹|rs\.?\s*)?(\d[\d,]*(?:\.\d+)?)\s*(k|thousand|lakhs?|lpa)?"
    low = F.lower(text)
    pattern = rf"(?:between\s+)?{amount}\s*(?:[-–]|to|and)\s*{amount}\s*(?:per annum|annual|yearly|p\.a\.|lpa|lakhs|ctc|per month|monthly|per year|usd|eur|gbp|inr)"
    whole = F.regexp_extract(low, pattern, 0)
    part = lambda g: F.regexp_extract(low, pattern, g)
    scale = lambda unit: F.when(unit.isin("k", "thousand"), 1000.0).when(unit.startswith("l"), 100000.0).otherwise(1.0)
    unit = F.when(part(4) != "", part(4)).when(whole.rlike("lakh|lpa"), "lpa").otherwise(part(2))
    value = lambda g: F.regexp_replace(part(g), ",", "").try_cast("double") * scale(F.when((part(2) != "") & F.lit(g == 1), part(2)).otherwise(unit))
    cur = None
    for name, p in CURRENCIES:
        cur = F.when(whole.rlike(p), name) if cur is None else cur.when(whole.rlike(p), name)
    period = F.when(whole.rlike(r"month|p\.m\."), "monthly").otherwise("annual")
    return F.when(whole != "", F.struct(value(1).alias("min"), value(3).alias("max"), cur.alias("currency"), period.alias("period")))


def requirement_lines(text: Column, cue: str) -> Column:
    """Distinct lines of 4 to 29 words that hold the cue, without their bullets, sorted."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•–\d]+\s*", "")))
    words = lambda x: F.size(F.split(x, r"\s+"))
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: (words(x) > 3) & (words(x) < 30) & x.rlike(cue))))


def certifications(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)certificates? in [A-Z][\w+#. -]*\w|\b(?:AWS|Azure|GCP|Oracle|Microsoft|Cisco) Certified\b|\b(?:PMP|CSM|CCNA|CKA|CEH)\b"), F.lit(0))))


def responsibilities(section: Column) -> Column:
    lines = F.transform(F.split(section, r"\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) > 3)


def keywords(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Distinct whole-word hits of the terms as written, sorted; where several fit, the first listed."""
    import re

    alternatives = "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{alternatives})\b"), F.lit(0))))


def degrees(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, degree, field, mandatory: distinct mentions by sentence. The first field of study of a sentence counts."""
    s = df.select(F.col(id_col), F.explode(F.split(F.lower(F.col(text_col)), r"\.(?:\s|$)|\n")).alias("s"))
    found = F.array_compact(F.array(*[F.when(F.col("s").rlike(rf"(?<![\w.])(?:{p})(?![\w])"), name) for name, p in DEGREES]))
    field = None
    for f in FIELDS:
        hit = F.col("s").rlike(rf"\b{f}\b")
        field = F.when(hit, f) if field is None else field.when(hit, f)
    return s.select(F.col(id_col), F.explode(found).alias("degree"), field.alias("field"), F.col("s").rlike("required|mandatory|must have").alias("mandatory")).distinct()


def _with_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and found: an array of (section, content), made within the row: no line leaves it, nothing is shuffled."""

    def mark(x: Column) -> Column:
        """The name of a heading, an empty one for a blank line, which closes a section, else null."""
        line = F.trim(x)
        out = F.when(line == "", "").when(F.size(F.split(line, r"\s+")) >= 10, F.lit(None).cast("string"))
        for name, p in SECTIONS:
            out = out.when(F.lower(line).rlike(p), name)
        return out

    d = df.select(F.col(id_col), F.col(text_col).alias("_text"), F.split(F.col(text_col), r"\r\n|\n|\r").alias("_lines"))
    d = d.withColumn("_marks", F.transform("_lines", mark))
    d = d.withColumn("_at", F.filter(F.transform("_marks", lambda m, i: F.when(m.isNotNull(), i)), lambda i: i.isNotNull()))
    island = lambda p, k: F.struct(F.get("_marks", p).alias("section"), p.alias("at"), (F.coalesce(F.get("_at", k + 1), F.size("_lines")) - p - 1).alias("n"))
    d = d.withColumn("_islands", F.filter(F.transform("_at", island), lambda x: (x["section"] != "") & (x["n"] > 0)))
    named = lambda name: lambda x: x["section"] == name
    last = F.array_compact(F.array(*[F.try_element_at(F.filter("_islands", named(name)), F.lit(-1)) for name, _ in SECTIONS]))
    content = lambda x: F.trim(F.array_join(F.slice("_lines", x["at"] + 2, x["n"]), "\n"))
    return d.select(id_col, "_text", F.transform(last, lambda x: F.struct(x["section"].alias("section"), content(x).alias("content"))).alias("_found"))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, section, content: lines under the last heading above, up to a blank line; of repeated headings the last counts.

    A heading is a line of fewer than ten words that matches one of the section patterns.
    """
    # The outer form: for the other, the optimizer would put a filter before it that makes the sections a second time.
    return _with_sections(df, id_col, text_col).select(id_col, F.inline_outer("_found")).where("section IS NOT NULL")


def all_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sections, and of each text that isn't null: its whole as unclassified, or as main_content if it has none.

    In main_content the white space around is left out and each gap between paragraphs is one blank line.
    """
    d = _with_sections(df.where(F.col(text_col).isNotNull()), id_col, text_col)
    inner = F.regexp_replace(F.regexp_replace("_text", f"^{WS}+", ""), f"{WS}+\\z", "")
    whole = F.when(F.size("_found") > 0, F.struct(F.lit("unclassified").alias("section"), F.col("_text").alias("content"))).otherwise(
        F.struct(F.lit("main_content").alias("section"), F.regexp_replace(inner, f"\n{WS}*\n", "\n\n").alias("content"))
    )
    return d.select(id_col, F.inline_outer(F.concat("_found", F.array(whole))))


def section_terms(df: DataFrame, parts: list[str], lexicon: list[str]) -> DataFrame:
    """Adds ``terms``: the lexicon's terms in the named parts of parsed descriptions: texts, lists of texts, or lists of
    structs of either; parts that aren't there count as empty."""

    def walk(c: Column, t: T.DataType) -> Column:
        """The texts of a value, as an array."""
        none = F.array().cast("array<string>")
        if isinstance(t, T.StringType):
            return F.array(c)
        if isinstance(t, T.StructType):
            inner = [walk(c[f.name], f.dataType) for f in t.fields]
            return F.flatten(F.array(none, *[F.coalesce(x, none) for x in inner]))
        if isinstance(t, T.ArrayType):
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(t)), lambda x: F.coalesce(walk(x, t.elementType), none)))
        return none

    here = [walk(F.col(p), df.schema[p].dataType) for p in parts if p in df.columns]
    joined = F.array_join(F.concat(F.array().cast("array<string>"), *[F.coalesce(x, F.array().cast("array<string>")) for x in here]), "\n")
    return extract_terms(df.withColumn("_texts", joined), "_texts", lexicon).drop("_texts")


def parse_jobs(df: DataFrame, id_col: str, text_col: str, technical: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """One row per job description with all that the text gives; responsibilities are the lines of that section."""
    t = F.col(text_col)
    duties = sections(df, id_col, text_col).where("section = 'responsibilities'").select(id_col, responsibilities(F.col("content")).alias("responsibilities"))
    taught = degrees(df, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("degree", "field", "mandatory"))).alias("education"))
    parsed = df.select(
        id_col, title(t).alias("title"), company(t).alias("company"), work_mode(t).alias("work_mode"), min_years(t).alias("min_years"), max_years(t).alias("max_years"), seniority(t).alias("seniority"),
        salary(t).alias("salary"), requirement_lines(t, MANDATORY).alias("mandatory"), requirement_lines(t, PREFERRED).alias("preferred"), certifications(t).alias("certifications"),
        keywords(t, technical).alias("technical"),
    )
    out = parsed.join(duties, id_col, "left").join(taught, id_col, "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("responsibilities", "education")}
    return out.withColumns(empty)
