"""Views the queries start from, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from ..operators.splits import split_name
from ..session import table

REGISTRY: dict[str, tuple] = {}
TRIM = r"regexp_replace({0}, '^[ \t\r\n\x{{00A0}}]+|[ \t\r\n\x{{00A0}}]+$', '', 'g')"
# white space as in functions.text.SPACE, in the other engine's spelling
W = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NORM = "regexp_replace(regexp_replace({0}, '[\\t\\r\\n ]+', ' ', 'g'), '^[" + W.replace("{", "{{").replace("}", "}}") + "]+|[" + W.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g')"
FOLD = "replace(lower({0}), 'ß', 'ss')"
LEXICAL = "regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’][\p{{L}}\p{{Nl}}\p{{No}}]+)*|\p{{Nd}}+')"
OVERLAP = "regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}_]+')"


def query(name: str, sql: str | None = None):
    """Registers a query (spark, root) → DataFrame under its name, with the SQL it is compared with."""

    def register(f):
        REGISTRY[name] = (f, sql)
        return f

    return register


def sql_split(column: str = "split") -> str:
    s = f"lower({TRIM.format(column)})"
    return f"CASE WHEN {s} IN ('val', 'dev', 'validation') THEN 'validation' ELSE {s} END"


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and columns of the last delivery; equal times are told apart by the columns, nulls first. A maximum of structs:
    it is combined before the shuffle, so that a key delivered very often costs no more than another."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("delivered_at", *columns)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in columns])


def sql_latest(name: str, key: str, *columns: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("delivered_at", *columns))
    return f"(SELECT {key}, {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {name} WHERE {key} IS NOT NULL) WHERE rn = 1)"


def segments(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return latest(table(spark, root, "master_segments"), "segment_id", *columns)


def sql_segments(*columns: str) -> str:
    return sql_latest("master_segments", "segment_id", *columns)


def pairs(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return latest(table(spark, root, "sft_pairs"), "segment_id", *columns)


def sql_pairs(*columns: str) -> str:
    return sql_latest("sft_pairs", "segment_id", *columns)


def atoms(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "partition_atoms").select(*columns).distinct()


def sql_atoms(*columns: str) -> str:
    return f"(SELECT DISTINCT {', '.join(columns)} FROM partition_atoms)"


def _atom_lines() -> Column:
    """The lines of an atom that aren't empty, with number, id and kind: kind by the atom's, a speaker's label where a
    speech begins with one."""
    split = F.split("text", "\n")
    kind = lambda x, i: (
        F.when(F.col("source_kind") == "stage", "stage").when((F.col("source_kind") == "speech") & (i == 0) & x.rlike(r"^\p{Lu}+\.( \(.*\))?\z"), "speaker").when(F.col("source_kind") == "p", "prose").otherwise("verse")
    )
    rows = F.transform(split, lambda x, i: F.struct(i.alias("event_index"), F.format_string("%s_E%04d", "atom_id", i + 1).alias("event_id"), kind(x, i).alias("kind"), x.alias("text")))
    return F.filter(rows, lambda r: r["text"] != "")


_ATOM = ("source_atom_id", "segment_id", "work_id", "source_kind")


def _event_atoms(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "partition_atoms").select("scene_id", "atom_id", *_ATOM, "text")
    return a.where("scene_id is not null and text is not null").repartition("atom_id").distinct()


def events(spark: SparkSession, root: str) -> DataFrame:
    """An event for each line of an atom that belongs to a scene."""
    e = _event_atoms(spark, root).select("scene_id", "atom_id", *_ATOM, F.inline(_atom_lines()))
    return e.withColumn("stanza_ids", F.array("source_kind"))


SQL_EVENTS = rf"""(SELECT atom_id, source_atom_id, segment_id, scene_id, work_id, source_kind, i AS event_index, printf('%s_E%04d', atom_id, i + 1) AS event_id, line AS text, [source_kind] AS stanza_ids,
  CASE WHEN source_kind = 'stage' THEN 'stage' WHEN source_kind = 'speech' AND i = 0 AND regexp_matches(line, '^\p{{Lu}}+\.( \(.*\))?$') THEN 'speaker' WHEN source_kind = 'p' THEN 'prose' ELSE 'verse' END AS kind
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {sql_atoms('atom_id', 'source_atom_id', 'segment_id', 'scene_id', 'work_id', 'source_kind', 'text')} WHERE scene_id IS NOT NULL AND text IS NOT NULL) WHERE line <> '')"""


def scene_events(spark: SparkSession, root: str) -> DataFrame:
    """events with scene_ord and atom_number (both from 1) within the scene."""
    e = sequence.number_events(_event_atoms(spark, root), _atom_lines(), *_ATOM)
    return e.withColumn("stanza_ids", F.array("source_kind"))


SQL_SCENE_EVENTS = f"(SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY atom_id, event_index) AS scene_ord, dense_rank() OVER (PARTITION BY scene_id ORDER BY atom_id) AS atom_number FROM {SQL_EVENTS})"

__all__ = ["FOLD", "LEXICAL", "NORM", "OVERLAP", "REGISTRY", "SQL_EVENTS", "SQL_SCENE_EVENTS", "TRIM", "W", "atoms", "events", "latest", "pairs", "query", "scene_events", "segments", "split_name", "sql_atoms", "sql_latest", "sql_pairs", "sql_segments", "sql_split", "table"]
