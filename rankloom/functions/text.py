"""Text as Column -> Column functions; all stay on the JVM inside code generation where Spark allows."""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

import pandas as pd

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stop list of the retrieval tokenizer.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might must shall can this that these those i you he she it we they what which who whom when "
    "where why how all each every both few more most other some such no nor not only own same so than too very just also "
    "now about into through during before after above below between under again further then once here there any if "
    "because until while our your their my his her its"
).split()

#: Written forms of skills and what they are normalised to.
SKILL_FORMS = {
    "js": "JavaScript", "py": "Python", "nodejs": "Node.js", "postgres": "PostgreSQL", "tf": "TensorFlow", "k8s": "Kubernetes", "aws": "AWS", "azure": "Azure", "gcp": "GCP", "ml": "Machine Learning", "ai": "Artificial Intelligence", "bi": "Business Intelligence",
    "ci/cd": "CI/CD", "devops": "DevOps", "api": "API", "rdbms": "RDBMS", "nosql": "NoSQL", "golang": "Go", "c#": "C#", "c++": "C++", "css": "CSS", "html": "HTML", "sql": "SQL", "git": "Git", "jira": "Jira", "agile": "Agile", "scrum": "Scrum", "linux": "Linux", "windows": "Windows", "macos": "macOS",
    "javascript": "JavaScript", "python": "Python", "node.js": "Node.js", "postgresql": "PostgreSQL", "tensorflow": "TensorFlow", "kubernetes": "Kubernetes", "amazon web services": "AWS", "microsoft azure": "Azure", "google cloud platform": "GCP", "machine learning": "Machine Learning", "artificial intelligence": "Artificial Intelligence", "business intelligence": "Business Intelligence", "relational database management system": "RDBMS", "go": "Go",
}
#: Synonyms looked up without case.
SYNONYMS = {
    "reactjs": "React", "tf 2": "TensorFlow", "aws ec2": "AWS", "azure devops": "Azure", "ms sql": "SQL Server", "gcp": "Google Cloud Platform", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "node": "Node.js", "expressjs": "Express.js", "nextjs": "Next.js", "angularjs": "Angular", "vuejs": "Vue.js", "c sharp": "C#", "dot net": ".NET", "net": ".NET", "rest api": "RESTful API", "graphql": "GraphQL", "html5": "HTML", "css3": "CSS", "sass": "Sass", "less": "Less", "bootstrap": "Bootstrap", "tailwind css": "Tailwind CSS",
    "material ui": "Material-UI", "ant design": "Ant Design", "postgresql": "PostgreSQL", "mongodb": "MongoDB", "mysql": "MySQL", "microsoft sql server": "SQL Server", "oracle db": "Oracle Database", "dynamodb": "DynamoDB", "google cloud": "Google Cloud Platform", "amazon web services": "AWS", "microsoft azure": "Azure", "docker": "Docker", "jenkins": "Jenkins", "travis ci": "Travis CI", "gitlab ci": "GitLab CI", "github actions": "GitHub Actions", "ansible": "Ansible", "puppet": "Puppet", "chef": "Chef", "terraform": "Terraform", "cloudformation": "CloudFormation",
    "machine learning": "Machine Learning", "deep learning": "Deep Learning", "natural language processing": "NLP", "computer vision": "Computer Vision", "nlp": "NLP", "cv": "Computer Vision", "pytorch": "PyTorch", "scikit-learn": "Scikit-learn", "pandas": "Pandas", "numpy": "NumPy", "spark": "Apache Spark", "hadoop": "Apache Hadoop", "kafka": "Apache Kafka", "data bricks": "Databricks", "snowflake": "Snowflake", "tableau": "Tableau", "power bi": "Power BI", "looker": "Looker", "qlikview": "QlikView", "git hub": "GitHub", "bit bucket": "Bitbucket", "gitlab": "GitLab", "svn": "SVN", "jira": "Jira", "confluence": "Confluence", "trello": "Trello", "asana": "Asana",
    "agile methodologies": "Agile", "scrum master": "Scrum", "kanban": "Kanban", "pmp": "PMP", "csm": "CSM", "aws certified": "AWS Certified", "azure certified": "Azure Certified", "google cloud certified": "GCP Certified", "communication": "Communication", "teamwork": "Teamwork", "problem solving": "Problem Solving", "critical thinking": "Critical Thinking", "adaptability": "Adaptability", "leadership": "Leadership", "time management": "Time Management", "project management": "Project Management", "data science": "Data Science", "big data": "Big Data", "etl": "ETL", "data warehousing": "Data Warehousing", "data lakes": "Data Lakes",
}
#: Ordered substring rules that put a skill into a category; the first that holds decides.
CATEGORY_RULES = (
    ("programming_languages", ("script",)), ("frameworks", ("framework", "mvc")), ("libraries", ("library", "sdk")), ("databases", ("database", "db", "sql", "nosql")), ("cloud_platforms", ("cloud", "aws", "azure", "gcp")),
    ("devops_tools", ("devops", "ci/cd", "pipeline", "container", "orchestration")), ("ai_ml", ("machine learning", "ml", "ai", "deep learning", "nlp", "computer vision")), ("data_engineering", ("data engineering", "etl", "data warehousing", "big data")), ("analytics_bi", ("analytics", "bi", "dashboard", "reporting")),
    ("operating_systems", ("os", "operating system", "linux", "windows", "macos")), ("version_control", ("version control", "git", "svn")), ("methodologies", ("agile", "scrum", "kanban", "methodology")), ("certifications", ("certified", "certification", "pmp", "csm")),
    ("soft_skills", ("communication", "teamwork", "problem solving", "critical thinking", "adaptability", "leadership", "time management", "collaboration", "creativity", "interpersonal")),
    ("technical_skills", ("development", "engineering", "architecture", "design", "security", "testing", "backend", "frontend", "fullstack", "programming", "coding", "system", "network")),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: Spark computes an expression used within a lambda again for each element."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """White space collapsed and stripped; null gives an empty string."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def tokens(c: Column, strategy: str = "standard", stop_words: list[str] | None = None) -> Column:
    """Lower-case words. standard: letters, digits and _ only, without stop words; minimal: split at white space only."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if strategy == "minimal":
        return F.filter(F.split(low, r"\s+"), lambda x: x != "")
    words = F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(words, lambda x: (x != "") & ~x.isin(stop)) if stop else F.filter(words, lambda x: x != "")


def counts(words: Column) -> Column:
    """Bag of words: word -> count."""
    def bag(w: Column) -> Column:
        distinct = F.array_distinct(w)
        return F.map_from_arrays(distinct, F.transform(distinct, lambda x: F.size(F.filter(w, lambda y: y == x)).cast("double")))

    return let(words, bag)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the bags of words (lower case, split at white space) of two texts; 0 if either is empty."""
    return _cosine_udf()(tokens(a, "minimal"), tokens(b, "minimal"))


@cache
def _cosine_udf():
    """Linear in the words, on Arrow batches; higher-order functions would compare every word with every other."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(x, y, strict=True):
            p, q = Counter(v), Counter(w)
            norm = math.sqrt(sum(n * n for n in p.values())) * math.sqrt(sum(n * n for n in q.values()))
            out.append(sum(n * q[t] for t, n in p.items()) / norm if norm else 0.0)
        return pd.Series(out, dtype="float64")

    return run


def normalize_skill(c: Column) -> Column:
    """Cleaned, in its usual writing; unknown skills come out in lower case."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s.\-/#+ ]", ""), r"\s+", " "))
    known = F.try_element_at(literal_map(SKILL_FORMS), s)
    return F.coalesce(known, s)


def map_synonym(c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SYNONYMS), F.lower(c)), c)


def categorize(c: Column, taxonomy: Column | None = None) -> Column:
    """Category of a skill: by the taxonomy (map of name to category), else by the ordered rules, else other_skills."""
    low = F.lower(c)
    out = None
    for name, parts in CATEGORY_RULES:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        if name == "programming_languages":
            hit = hit & ~low.contains("shell")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.otherwise("other_skills")
    return F.coalesce(F.try_element_at(taxonomy, c), out) if taxonomy is not None else out


def extract_terms(df: DataFrame, text_col: str, lexicon: list[str], match: str = "substring") -> DataFrame:
    """Adds ``terms``: the lexicon's terms a text holds, lower case and sorted. match: substring, or word for whole words."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = sorted({w.lower() for w in lexicon})
    if match == "word":
        padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}+#./-]+", " "), F.lit(" "))
        hits = [F.when(padded.contains(f" {w} "), w) for w in words]
    else:
        hits = [F.when(low.contains(w), w) for w in words]
    return df.withColumn("terms", F.array_compact(F.array(*hits)))


def substitute(template: str, values: dict[str, Column]) -> Column:
    """$name and ${name} of a template replaced by columns; a name without a value raises KeyError."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+)|\$)", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m.group(1) or m.group(2)
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")) if name else F.lit("$"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """(c - low) / (high - low) within [0, 1]; 0 of null, and where the two are equal."""
    if high == low:
        return F.lit(0.0)
    return F.when(c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / F.lit(float(high - low)))))
