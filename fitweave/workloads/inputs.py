"""Input tables of the jobs, derived from the given tables (and the same in SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TEXT_TABLES = {"documents", "pages", "conversations"}
#: Session setting: so many partitions for every table of texts, whatever its size. Unset, tables are read as Spark splits them.
INPUT_PARTITIONS = "fitweave.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """``spread`` deals the rows evenly over tasks before costly work on texts: files may be few, or hold few row groups."""
    rows, parts = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get(INPUT_PARTITIONS, None)
    if parts and name in TEXT_TABLES:
        return rows.repartition(int(parts))
    return rows.hint("rebalance") if spread else rows


# The prose of ``documents`` names no skills. Some of its invented words stand
# for labels and cue words, so whole documents become postings, CVs and letters.
WORDS = {
    "erin": "Python", "thhe": "Kubernetes", "thtion": "Jenkins", "thti": "GitHub Actions", "thor": "CI/CD",
    "thly": "Docker", "then": "Postgres", "thst": "SQL", "thin": "Azure", "thing": "Azure DevOps",
    "attion": "AWS", "erer": "Amazon Web Services", "thnd": "Linux", "eren": "RHEL", "thsh": "Go",
    "eror": "Java", "eron": "TypeScript", "erth": "Terraform", "thou": "Prometheus", "ered": "Monitoring",
    "thwh": "communication", "erhe": "stakeholders", "eran": "mentoring", "erre": "deadlines",
    "erly": "must", "erble": "required", "erat": "preferred", "erst": "nice to have", "thanedble": "not",
    "onre": "learning", "onan": "built", "onin": "maintained", "eres": "or", "erwh": "Node.js",
    "ersh": "React", "erha": "K8s", "pour": "Ansible", "qui": "Git", "sich": "GitLab", "zu": "C++",
    "mit": "Grafana", "los": "ELK", "dans": "Logging", "por": "Redis", "thre": "I", "thon": "my",
    "thnt": "5 years", "thes": "12%", "thble": "2019-2022", "ther": "3 years of experience",
    "thha": "github.com/octo-dev", "thea": "https://www.linkedin.com/in/jo_doe/", "thth": "deployed",
    "than": "2018 to present", "wh": "but", "onne": "github.com/features",
}


def skill_text(text: Column) -> Column:
    for word, label in WORDS.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {label} "))
    return F.replace(text, F.lit("er.\n"), F.lit("er:\n"))


def skill_text_sql(column: str = "text") -> str:
    for word, label in WORDS.items():
        column = f"replace({column}, ' {word} ', ' {label} ')"
    return f"replace({column}, 'er.' || chr(10), 'er:' || chr(10))"


def skill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, text): whole documents with skill words."""
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", "lang", "source", skill_text(F.col("text")).alias("text"))


SKILL_DOCUMENTS = f"skill_docs AS MATERIALIZED (SELECT doc_id, lang, source, {skill_text_sql()} AS text FROM documents)"
