"""Queries of text functions and job-description parsing over the documents, and of skills over the skills table."""

from __future__ import annotations


from pyspark.sql import functions as F

from rankloom.functions import jobs, text
from rankloom.plans.catalogue import ORACLES, query, table
from rankloom.plans.retrieval import words_sql
from rankloom.session import spread

_MAP = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


@query("tokenize_stats", f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def tokenize_stats(spark, sf_dir):
    w = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("minimal_tokens", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x{0b}]+'), lambda x: x <> '')) AS n FROM documents")
def minimal_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"), "minimal")).cast("long").alias("n"))


@query("stopword_filter", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+')) AS w FROM documents) WHERE w IN (" + ", ".join(f"'{x}'" for x in text.STOP_WORDS) + ") GROUP BY w")
def stopword_filter(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"), stop_words=[])).alias("word"))
    return w.where(F.col("word").isin(text.STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


@query("bow_cosine", """
WITH p AS (SELECT exp_id, regexp_split_to_array(lower(coalesce(title, '')), '[\\s\\x{0b}]+') AS a, regexp_split_to_array(lower(coalesce(description, '')), '[\\s\\x{0b}]+') AS b FROM experience),
     x AS (SELECT exp_id, w, count(*) AS n FROM (SELECT exp_id, unnest(a) AS w FROM p) WHERE w <> '' GROUP BY 1, 2), y AS (SELECT exp_id, w, count(*) AS n FROM (SELECT exp_id, unnest(b) AS w FROM p) WHERE w <> '' GROUP BY 1, 2),
     d AS (SELECT x.exp_id, sum(x.n * y.n) AS s FROM x JOIN y ON x.exp_id = y.exp_id AND x.w = y.w GROUP BY 1), nx AS (SELECT exp_id, sqrt(sum(n * n)) AS s FROM x GROUP BY 1), ny AS (SELECT exp_id, sqrt(sum(n * n)) AS s FROM y GROUP BY 1)
SELECT p.exp_id, coalesce(round(d.s / (nx.s * ny.s), 6), 0.0) AS cosine FROM p LEFT JOIN d USING (exp_id) LEFT JOIN nx USING (exp_id) LEFT JOIN ny USING (exp_id)""")
def bow_cosine(spark, sf_dir):
    return table(spark, sf_dir, "experience").select("exp_id", F.round(text.cosine(F.col("title"), F.col("description")), 6).alias("cosine"))


def _lexicon(spark, sf_dir) -> list[str]:
    """The skill list; a bounded reference table."""
    return sorted(r.canonical for r in table(spark, sf_dir, "ref_values").where("field = 'skills.name'").select("canonical").distinct().collect())


@query("skill_extract", "SELECT doc_id, list_sort(list(DISTINCT lower(canonical))) AS terms FROM documents, ref_values WHERE field = 'skills.name' AND contains(lower(text), lower(canonical)) GROUP BY doc_id UNION ALL SELECT doc_id, []::VARCHAR[] FROM documents WHERE NOT EXISTS (SELECT 1 FROM ref_values WHERE field = 'skills.name' AND contains(lower(text), lower(canonical)))")
def skill_extract(spark, sf_dir):
    return text.extract_terms(table(spark, sf_dir, "documents"), "text", _lexicon(spark, sf_dir)).select("doc_id", "terms")


_NORM = f"coalesce({_MAP(text.SKILL_FORMS)}[clean], clean)"
_CLEAN = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s.\\-/#+ ]', '', 'g'), '\\s+', ' ', 'g'), ' ')"


@query("skill_normalize", f"SELECT skill_id, {_NORM} AS skill FROM (SELECT skill_id, {_CLEAN} AS clean FROM skills)")
def skill_normalize(spark, sf_dir):
    return table(spark, sf_dir, "skills").select("skill_id", text.normalize_skill(F.col("name")).alias("skill"))


@query("skill_synonyms", f"SELECT skill_id, coalesce({_MAP(text.SYNONYMS)}[lower(name)], name) AS skill FROM skills")
def skill_synonyms(spark, sf_dir):
    return table(spark, sf_dir, "skills").select("skill_id", text.map_synonym(F.col("name")).alias("skill"))


def _category_sql(c: str) -> str:
    cases = []
    for name, parts in text.CATEGORY_RULES:
        hit = "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in parts) + ")"
        cases.append(f"WHEN {hit}{' AND NOT contains(lower(' + c + '), ' + repr('shell') + ')' if name == 'programming_languages' else ''} THEN '{name}'")
    return "CASE " + " ".join(cases) + " ELSE 'other_skills' END"


@query("skill_taxonomy", f"SELECT skill_id, {_category_sql('name')} AS category FROM skills WHERE name IS NOT NULL")
def skill_taxonomy(spark, sf_dir):
    return table(spark, sf_dir, "skills").where("name IS NOT NULL").select("skill_id", text.categorize(F.col("name")).alias("category"))


@query("skill_pipeline", f"""
WITH n AS (SELECT candidate_id, {_NORM} AS s FROM (SELECT candidate_id, {_CLEAN} AS clean FROM skills WHERE name IS NOT NULL)), m AS (SELECT candidate_id, coalesce({_MAP(text.SYNONYMS)}[lower(s)], s) AS s FROM n WHERE s <> '')
SELECT candidate_id, {_category_sql("s")} AS category, list_sort(list(DISTINCT s)) AS skills FROM m GROUP BY 1, 2""")
def skill_pipeline(spark, sf_dir):
    """Normalise, map synonyms, distinct, and collect by category."""
    d = table(spark, sf_dir, "skills").where("name IS NOT NULL").select("candidate_id", text.normalize_skill(F.col("name")).alias("s")).where("s <> ''")
    d = d.select("candidate_id", text.map_synonym(F.col("s")).alias("s")).distinct()
    return d.groupBy("candidate_id", text.categorize(F.col("s")).alias("category")).agg(F.array_sort(F.collect_set("s")).alias("skills"))


@query("template_text", "SELECT doc_id, 'Document ' || doc_id || ' (' || coalesce(lang, '') || ') costs $5' AS line FROM documents")
def template_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.substitute("Document $id (${lang}) costs $$5", {"id": F.col("doc_id"), "lang": F.col("lang")}).alias("line"))


def _all(p: str, g: int, c: str = "text") -> str:
    return f"list_transform(regexp_extract_all({c}, '(?i){p}', {g}), lambda x: TRY_CAST(x AS INTEGER))"


_MIN = "list_max(list_concat(" + ", ".join([*[_all(p, 1) for p in jobs.YEARS], _all(jobs.YEARS_RANGE, 1)]) + "))"
_MAX = f"list_min({_all(jobs.YEARS_RANGE, 2)})"


@query("experience_range", f"SELECT doc_id, {_MIN} AS min_years, {_MAX} AS max_years FROM documents WHERE text IS NOT NULL")
def experience_range(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", jobs.min_years(t).alias("min_years"), jobs.max_years(t).alias("max_years"))


@query("seniority", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b(?:{w})\\b') THEN '{n}'" for n, w in jobs.SENIORITY) + f" WHEN {_MIN} >= 7 THEN 'senior' WHEN {_MIN} >= 3 THEN 'mid' WHEN {_MIN} >= 0 THEN 'junior' WHEN {_MAX} <= 2 THEN 'junior' END AS seniority FROM documents WHERE text IS NOT NULL")
def seniority(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", jobs.seniority(F.col("text")).alias("seniority"))


_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@query("title_location", f"""
SELECT doc_id, trim(list_filter({_LINES}, lambda x: regexp_matches(x, '[^\\s\\x{{0b}}]'))[1], ' ') AS title, nullif(lower(regexp_extract(text, '(?i)\\b(remote|hybrid|on-site)\\b', 1)), '') AS work_mode FROM documents WHERE text IS NOT NULL""")
def title_location(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", jobs.title(t).alias("title"), jobs.work_mode(t).alias("work_mode"))


@query("company_mentions", "SELECT doc_id, nullif(trim(regexp_extract(text, '(?:at|bei|chez|en)\\s+([A-Z][a-zA-Z&, -]+?(?:Ltd|LLC|LLP|Inc|Corp|Group|GmbH|Limited|Incorporated|Corporation))\\b', 1), ' '), '') AS company FROM documents")
def company_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", jobs.company(F.col("text")).alias("company"))


_REQ = lambda cue: f"list_sort(list_distinct(list_filter(list_transform({_LINES}, lambda x: trim(regexp_replace(x, '^[\\s\\x{{0b}}]*[-*•–\\d]+[\\s\\x{{0b}}]*', ''), ' ')), lambda x: len(regexp_split_to_array(x, '[\\s\\x{{0b}}]+')) BETWEEN 4 AND 29 AND regexp_matches(x, '{cue}'))))"


@query("requirement_lines", f"SELECT doc_id, {_REQ(jobs.MANDATORY)} AS mandatory, {_REQ(jobs.PREFERRED)} AS preferred FROM documents WHERE text IS NOT NULL")
def requirement_lines(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", jobs.requirement_lines(t, jobs.MANDATORY).alias("mandatory"), jobs.requirement_lines(t, jobs.PREFERRED).alias("preferred"))


@query("keyword_regex", """
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?i)\\b(?:Apache Kafka|Kafka|Apache Spark|Spark|Python|JavaScript|TypeScript|Power BI|Machine Learning|Scikit-learn)\\b', 0))) AS keywords FROM documents WHERE text IS NOT NULL""")
def keyword_regex(spark, sf_dir):
    terms = ["Apache Kafka", "Kafka", "Apache Spark", "Spark", "Python", "JavaScript", "TypeScript", "Power BI", "Machine Learning", "Scikit-learn"]
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", jobs.keywords(F.col("text"), terms).alias("keywords"))


@query("salary_parse", """
WITH m AS (SELECT doc_id, regexp_extract(lower(text), 'between\\s+(\\d+) and (\\d+) lakhs', 1) AS a, regexp_extract(lower(text), 'between\\s+(\\d+) and (\\d+) lakhs', 2) AS b FROM documents)
SELECT doc_id, a::DOUBLE * 100000 AS min, b::DOUBLE * 100000 AS max, 'INR' AS currency, 'annual' AS period FROM m WHERE a <> ''""")
def salary_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", jobs.salary(F.col("text")).alias("s"))
    return d.where("s IS NOT NULL").select("doc_id", "s.*")


@query("certification_scan", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?i)certificates? in [A-Z][\\w+#. -]*\\w|\\b(?:AWS|Azure|GCP|Oracle|Microsoft|Cisco) Certified\\b|\\b(?:PMP|CSM|CCNA|CKA|CEH)\\b', 0))) AS certifications FROM documents WHERE text IS NOT NULL")
def certification_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", jobs.certifications(F.col("text")).alias("certifications"))


@query("education_scan")
def education_scan(spark, sf_dir):
    return jobs.degrees(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")


_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{n}'" for n, p in jobs.SECTIONS) + " END"


@query("section_split", f"""
WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS pos FROM documents WHERE text IS NOT NULL),
     m AS (SELECT *, trim(line, ' ') AS t FROM l),
     k AS (SELECT *, CASE WHEN t = '' THEN '' WHEN len(regexp_split_to_array(t, '[\\s\\x{{0b}}]+')) < 10 THEN {_HEAD} END AS mark FROM m),
     w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section, count(mark) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM k),
     p AS (SELECT doc_id, section, island, string_agg(line, chr(10) ORDER BY pos) AS content FROM w WHERE mark IS NULL AND section <> '' GROUP BY 1, 2, 3)
SELECT doc_id, section, trim(content, ' ') AS content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY island DESC) AS n FROM p) WHERE n = 1""")
def section_split(spark, sf_dir):
    return jobs.sections(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


_INNER = f"regexp_replace(regexp_replace(regexp_replace(text, '^{jobs.WS}+', ''), '{jobs.WS}+\\z', ''), '\\n{jobs.WS}*\\n', chr(10) || chr(10), 'g')"


@query("section_split_whole", f"""
WITH f AS ({ORACLES["section_split"]})
SELECT * FROM f UNION ALL SELECT doc_id, 'unclassified', text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM f)
UNION ALL SELECT doc_id, 'main_content', {_INNER} FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM f)""")
def section_split_whole(spark, sf_dir):
    """The sections with the whole text beside them, or in their place; section_split gives the found ones alone."""
    return jobs.all_sections(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query("job_parse")
def job_parse(spark, sf_dir):
    return jobs.parse_jobs(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
