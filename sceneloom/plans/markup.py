"""Queries on marked-up documents. The documents are made of the atoms: for each hundred atoms of a scene a play with
nested divisions, loose blocks, editorial choices, notes, line breaks, inline directions and loose text, whose parsed
rows SQL derives from the atoms alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import in_order, norm, sha256
from ..sources import tei
from .base import *

_SIZE = 100
_BODY = "/t:TEI/t:text[1]/t:body[1]/t:div[1]"


def _tagged(tag, content):
    return F.concat(F.lit("<"), tag, F.lit(">"), content, F.lit("</"), tag, F.lit(">"))


def documents(spark, root) -> DataFrame:
    """work_id, content. Atoms of even numbers lie in an inner division, the others loose behind it."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\r"), F.lit(" "))
    e = events(spark, root).where(norm(F.col("text")) != "")
    n = F.regexp_extract("atom_id", r"_A(\d+)", 1).cast("int")
    tag = F.when(F.col("kind") == "prose", "p").when(F.col("kind") == "verse", "l").otherwise(F.col("kind"))
    x, i = esc(F.col("text")), F.col("event_index") % 5
    line = (
        F.when(i == 1, F.concat(F.lit("<choice><corr>falsch</corr><orig>"), x, F.lit("</orig></choice>")))
        .when(i == 2, F.concat(x, F.lit("<note>Anmerkung</note>")))
        .when(i == 3, F.concat(F.lit("<hi>"), x, F.lit("</hi><lb/>")))
        .when((i == 4) & (F.col("kind") == "verse"), F.concat(x, F.lit("<stage>leise</stage>")))
        .otherwise(x)
    )
    rows = e.select(F.format_string("%s_B%03d", "scene_id", F.floor(n / _SIZE)).alias("work_id"), "scene_id", (n % 2).alias("part"), "atom_id", "source_kind", "event_index", _tagged(tag, line).alias("x"))
    a = rows.groupBy("work_id", "scene_id", "part", "atom_id", "source_kind").agg(F.array_join(in_order(F.col("x"), F.col("event_index")), "\n").alias("x"))
    k = F.col("source_kind")
    whole = F.when(k == "speech", F.concat(F.lit('<sp who="#wirt  #bote">'), "x", F.lit("</sp>"))).when(k == "lg", _tagged(F.lit("lg"), F.col("x"))).otherwise(F.concat(F.lit("<q>los"), "x", F.lit("</q>")))
    a = a.select("work_id", "scene_id", F.struct("part", "atom_id", whole.alias("x")).alias("a"))
    d = a.groupBy("work_id", "scene_id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    part = lambda p: F.array_join(F.transform(F.filter("a", lambda s: s["part"] == p), lambda s: s["x"]), "")
    doc = F.concat(
        F.lit(f'<TEI xmlns="{tei.NAMESPACE}"><teiHeader><person xml:id="wirt"><persName>Der  Wirt</persName></person><licence>frei</licence></teiHeader><text><body><div type="Szene"><head>'),
        F.col("scene_id"), F.lit('</head>\n<div type="teil"><head>Auftritt</head>'), part(0), F.lit("</div>\n"), part(1), F.lit("</div></body></text></TEI>"),
    )
    return d.select("work_id", F.encode(doc, "utf-8").alias("content"))


# every event of these documents, in order: x is the text, loose text included, path the one of its atom, leaf the step to it
_SQL = f"""WITH base AS (SELECT printf('%s_B%03d', scene_id, n // {_SIZE}) AS work_id, scene_id, n % 2 AS part, atom_id, source_kind, event_index AS i, kind, CASE WHEN event_index % 5 = 4 AND kind = 'verse' THEN {NORM.format(chr(34) + 'text' + chr(34) + " || 'leise'")} ELSE {NORM.format('text')} END AS x
    FROM (SELECT *, CAST(regexp_extract(atom_id, '_A(\\d+)', 1) AS INT) AS n FROM {SQL_EVENTS}) WHERE {NORM.format('text')} <> ''),
  atom AS (SELECT *, CASE source_kind WHEN 'speech' THEN 'sp' WHEN 'lg' THEN 'lg' ELSE 'q' END AS atag FROM (SELECT DISTINCT work_id, scene_id, part, atom_id, source_kind FROM base)),
  scene AS (SELECT *, dense_rank() OVER (PARTITION BY work_id ORDER BY part) AS s FROM atom),
  placed AS (SELECT *, printf('%s_S%03d', work_id, s) AS sid, row_number() OVER (PARTITION BY work_id, part ORDER BY atom_id) AS k,
    '{_BODY}' || CASE part WHEN 0 THEN '/t:div[1]' ELSE '' END || '/t:' || atag || '[' || row_number() OVER (PARTITION BY work_id, part, atag ORDER BY atom_id) || ']' AS apath FROM scene),
  leaves AS (SELECT work_id, scene_id, part, sid, k, apath, atag, i, kind, x,
    apath || '/t:' || CASE kind WHEN 'verse' THEN 'l' WHEN 'prose' THEN 'p' ELSE kind END || '[' || row_number() OVER (PARTITION BY work_id, part, k, kind ORDER BY i) || ']' AS xpath FROM base JOIN placed USING (work_id, scene_id, part, atom_id, source_kind)),
  ev AS (SELECT * FROM leaves UNION ALL SELECT work_id, scene_id, part, sid, k, apath, atag, -1, 'unclassified_text', 'los', apath || '/text()' FROM placed WHERE atag = 'q')
  """


def _read(spark, root):
    rows = tei.marks(documents(spark, root), largest=None)
    return rows, tei.events(rows)


@query(
    "tei_events",
    _SQL + """SELECT work_id, count(*) AS events, count(*) FILTER (kind = 'verse') AS verses, count(*) FILTER (kind = 'speaker') AS labels, count(*) FILTER (kind = 'stage') AS stages, count(*) FILTER (kind = 'unclassified_text') AS to_review,
    count(*) FILTER (kind = 'verse' AND i % 5 = 4) AS with_inline_stage, sha256(string_agg(x, chr(10) ORDER BY part, k, i)) AS sha FROM ev GROUP BY 1""",
)
def tei_events(spark, root):
    """Leaves become events in reading order; notes go, one alternative stays, inline directions stay and are listed."""
    e = _read(spark, root)[1]
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("verse", "verses"), ("speaker", "labels"), ("stage", "stages"))]
    return e.groupBy("work_id").agg(F.count(F.lit(1)).alias("events"), *kinds, F.count_if("requires_review").alias("to_review"), F.count_if(F.array_contains("stages", "leise")).alias("with_inline_stage"), sha256(F.array_join(in_order(F.col("text"), F.col("ord")), "\n")).alias("sha"))


@query("tei_paths", _SQL + "SELECT work_id, sha256(string_agg(xpath, chr(10) ORDER BY part, k, i)) AS sha, min(xpath) AS least, max(xpath) AS most FROM ev GROUP BY 1")
def tei_paths(spark, root):
    """The path of every event."""
    e = _read(spark, root)[1]
    return e.groupBy("work_id").agg(sha256(F.array_join(in_order(F.col("xpath"), F.col("ord")), "\n")).alias("sha"), F.min("xpath").alias("least"), F.max("xpath").alias("most"))


@query(
    "tei_atoms",
    _SQL + """SELECT printf('%s_A%04d', sid, k) AS atom_id, any_value(CASE atag WHEN 'sp' THEN 'speech' ELSE atag END) AS kind, any_value(CASE atag WHEN 'sp' THEN 'wirt,bote' ELSE '' END) AS speakers, coalesce(string_agg(x, '|' ORDER BY i) FILTER (kind = 'speaker'), '') AS labels,
    coalesce(string_agg(v::VARCHAR, ',' ORDER BY i) FILTER (kind = 'verse'), '') AS verse_indices, sha256(string_agg(glue || x, '' ORDER BY i)) AS text_sha256
    FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN kind = 'verse' AND lag(kind) OVER w = 'verse' THEN chr(10) ELSE chr(10) || chr(10) END AS glue, sum((kind = 'verse')::INT) OVER (PARTITION BY work_id ORDER BY part, k, i) AS v FROM ev WINDOW w AS (PARTITION BY work_id, part, k ORDER BY i)) GROUP BY sid, k""",
)
def tei_atoms(spark, root):
    """Atoms with kind, speakers, labels, running verse numbers, rendered text."""
    a = tei.atoms(_read(spark, root)[1])
    return a.select("atom_id", "kind", F.array_join("speakers", ",").alias("speakers"), F.array_join("speaker_labels", "|").alias("labels"), F.array_join(F.transform("verse_indices", lambda v: v.cast("string")), ",").alias("verse_indices"), "text_sha256")


@query(
    "tei_scenes",
    _SQL + f"""SELECT sid AS scene_id, work_id || '_G_' || substr(sha256('{_BODY}'), 1, 12) AS scene_group_id, any_value(CASE part WHEN 0 THEN 'Auftritt' ELSE scene_id END) AS scene_title, any_value('{_BODY}' || CASE part WHEN 0 THEN '/t:div[1]' ELSE '/block[2]' END) AS scene_xpath,
    any_value(scene_id || '/Szene' || CASE part WHEN 0 THEN '|Auftritt/teil' ELSE '' END) AS hierarchy, count(DISTINCT k)::INT AS atoms FROM ev GROUP BY sid, work_id""",
)
def tei_scenes(spark, root):
    """Divisions and loose blocks as scenes, their titles, groups and hierarchies."""
    e = _read(spark, root)[1]
    s = tei.scenes(e, tei.atoms(e))
    return s.select("scene_id", "scene_group_id", "scene_title", "scene_xpath", F.array_join(F.transform("hierarchy", lambda h: F.concat_ws("/", h["title"], h["type"])), "|").alias("hierarchy"), F.size("atom_ids").alias("atoms"))


_SQL_LOG = """SELECT work_id, kind, tag, n, sha FROM (
  SELECT work_id, 'exclusion' AS kind, 'note' AS tag, count(*) AS n, sha256(string_agg(xpath || '/t:note[1]=Anmerkung', chr(10) ORDER BY xpath || '/t:note[1]')) AS sha FROM leaves WHERE i % 5 = 2 GROUP BY 1
  UNION ALL SELECT work_id, 'choice', 'choice', count(*), sha256(string_agg(xpath || '/t:choice[1]=' || xpath || '/t:choice[1]/t:orig[1]', chr(10) ORDER BY xpath || '/t:choice[1]')) FROM leaves WHERE i % 5 = 1 GROUP BY 1
  UNION ALL SELECT work_id, 'markup', 'hi', count(*), sha256(string_agg(xpath || '/t:hi[1]=' || x, chr(10) ORDER BY xpath || '/t:hi[1]')) FROM leaves WHERE i % 5 = 3 GROUP BY 1
  UNION ALL SELECT DISTINCT work_id, 'heading', 'head', 2, sha256('{0}/t:div[1]/t:head[1]=Auftritt' || chr(10) || '{0}/t:head[1]=' || scene_id) FROM base
  UNION ALL SELECT DISTINCT work_id, 'structure', 'div', 2, sha256('{0}=' || scene_id || chr(10) || '{0}/t:div[1]=Auftritt') FROM base
  UNION ALL SELECT DISTINCT work_id, 'person', 'person', 1, sha256('/t:TEI/t:teiHeader[1]/t:person[1]=Der Wirt') FROM base
  UNION ALL SELECT DISTINCT work_id, 'licence', 'licence', 1, sha256('/t:TEI/t:teiHeader[1]/t:licence[1]=frei') FROM base)""".replace("{0}", _BODY)


@query("tei_logs", _SQL + _SQL_LOG)
def tei_logs(spark, root):
    """What was left out, chosen, emphasised, and the headings, divisions, persons and licences."""
    rows = tei.marks(documents(spark, root), largest=None)
    parts = [
        tei.exclusions(rows).select("work_id", F.lit("exclusion").alias("kind"), "tag", "xpath", F.col("text").alias("t")),
        tei.choices(rows).select("work_id", F.lit("choice"), "tag", "xpath", "selected_xpath"),
        tei.inline_markup(rows).select("work_id", F.lit("markup"), "tag", "xpath", "text"),
        tei.headings(rows).select("work_id", F.lit("heading"), F.lit("head"), "xpath", "text"),
        tei.structure(rows).select("work_id", F.lit("structure"), F.lit("div"), "xpath", F.array_join("direct_titles", "|")),
        tei.persons(rows).select("work_id", F.lit("person"), "kind", "xpath", F.array_join("names", "|")),
        tei.licences(rows).select("work_id", F.lit("licence"), F.lit("licence"), "xpath", "text"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("work_id", "kind", "tag").agg(F.count(F.lit(1)).alias("n"), sha256(F.array_join(in_order(F.concat_ws("=", "xpath", "t"), F.col("xpath")), "\n")).alias("sha"))


@query("tei_unknown_speakers", _SQL + "SELECT work_id, CASE WHEN bool_or(atag = 'sp') THEN 'bote' ELSE '' END AS unknown FROM ev GROUP BY 1")
def tei_unknown(spark, root):
    """Speakers without a person."""
    rows, e = _read(spark, root)
    return tei.unknown_speakers(rows, e).select("work_id", F.array_join("unknown", ",").alias("unknown"))


@query("tei_line_coverage", _SQL + "SELECT work_id, count(*) AS expected, count(*) AS found, 0::BIGINT AS differing, max(xpath) AS last FROM leaves WHERE kind = 'verse' GROUP BY 1")
def tei_coverage(spark, root):
    """Verse lines by an independent walk against the verse events, one by one."""
    rows, e = _read(spark, root)
    c = tei.line_coverage(rows, e)
    return c.groupBy("work_id").agg(F.count("expected").alias("expected"), F.count("found").alias("found"), F.count_if(~F.col("expected").eqNullSafe(F.col("found"))).alias("differing"), F.max("expected").alias("last"))
