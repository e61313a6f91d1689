"""Queries over conversations and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.words import EXPANSION_STOP, sql_list
from quillmesh.operators import chat
from quillmesh.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
LAST = "last AS (SELECT conv_id, max(turn) AS upto, arg_max(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id)"


def first_terms(source: str, limit: int) -> str:
    """The distinct terms of ``conv_id, text``, the first ones in order: rows ``conv_id, t, i``."""
    return f"""(SELECT conv_id, t, min(i) AS i FROM (SELECT conv_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, regexp_extract_all(text, '[a-zA-Z_][A-Za-z0-9_]+') AS l FROM {source}))
  WHERE length(t) >= 3 AND lower(t) NOT IN ({sql_list(EXPANSION_STOP)}) GROUP BY conv_id, t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(i)) <= {limit})"""


@query(f"""
WITH {LAST},
prior AS (SELECT c.* FROM conversations c JOIN last USING (conv_id) WHERE turn < upto),
u AS (SELECT conv_id, arg_max(text, turn) AS text FROM prior WHERE role = 'user' GROUP BY ALL),
m AS (SELECT conv_id, substr(arg_max(text, turn), 1, 600) AS text FROM prior WHERE role = 'assistant' GROUP BY ALL),
terms AS (SELECT conv_id, t, min(i) AS i FROM (SELECT conv_id, t, i FROM {first_terms('u', 8)} UNION ALL SELECT conv_id, t, i + 1000000 FROM {first_terms('m', 8)}) GROUP BY ALL),
j AS (SELECT conv_id, string_agg(t, ' ' ORDER BY i) AS extra FROM terms GROUP BY ALL),
q AS (SELECT conv_id, trim(message, {TRIM}) AS q FROM last)
SELECT q.conv_id, CASE WHEN extra IS NOT NULL AND len(list_filter(regexp_extract_all(lower(q), '[a-z]+'), lambda t: length(t) >= 3 AND t NOT IN ({sql_list(EXPANSION_STOP)}))) <= 2
  THEN q || ' ' || extra ELSE q END AS query FROM q LEFT JOIN j ON j.conv_id = q.conv_id""")
def followup_context(spark, sf_dir):
    return chat.contextual_queries(turns(spark, sf_dir))


@query(f"""
WITH {LAST}, q AS (SELECT conv_id, trim(message, {TRIM}) AS q FROM last),
s AS (SELECT conv_id, q, list_filter(regexp_extract_all(q, '[a-zA-Z_][A-Za-z0-9_]+'), lambda s: length(s) >= 3 AND lower(s) NOT IN ({sql_list(EXPANSION_STOP)})
  AND (regexp_matches(s, '[A-Z]') OR contains(s, '_') OR length(s) >= 6)) AS found FROM q)
SELECT conv_id, q AS query, CASE WHEN len(found) > 0 THEN array_to_string(found, ' ') || ' implementation definition' END AS variant FROM s""")
def expand_query(spark, sf_dir):
    rows = chat.last_user_turns(turns(spark, sf_dir)).select("conv_id", chat.expanded(F.col("message")).alias("v"))
    return rows.select("conv_id", F.col("v")[0].alias("query"), F.get("v", F.lit(1)).alias("variant"))


# DuckDB's patterns know boundaries of ASCII words alone
_SQL_OVERVIEW, _SQL_FACT = (tuple(p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b") for p in patterns) for patterns in (chat.OVERVIEW, chat.FACT))


def _any_sql(patterns) -> str:
    return " OR ".join(f"regexp_matches(lower(coalesce(text, '')), '{p}')" for p in patterns)


@query(f"SELECT conv_id, turn, ({_any_sql(_SQL_OVERVIEW)}) AS overview, ({_any_sql(_SQL_FACT)}) AS fact FROM conversations")
def query_flags(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", chat.matches_any(F.col("text"), chat.OVERVIEW).alias("overview"), chat.matches_any(F.col("text"), chat.FACT).alias("fact"))


def _window_sql(most: int) -> str:
    return f"""
WITH {LAST}, w AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS back FROM conversations c JOIN last USING (conv_id) WHERE turn < upto AND role <> 'system' QUALIFY back <= {most})
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w"""


def _window(spark, sf_dir, provider):
    return chat.history_window(turns(spark, sf_dir), chat.HISTORY[provider]).withColumn("n", F.col("n").cast("long"))


@query(_window_sql(6))
def chat_window_local(spark, sf_dir):
    return _window(spark, sf_dir, "mlc")


@query(_window_sql(10))
def chat_window_hosted(spark, sf_dir):
    return _window(spark, sf_dir, "gemini")


ISLANDS = f"""
spoken AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role FROM conversations WHERE role <> 'system' AND trim(coalesce(text, ''), {TRIM}) <> ''),
marked AS (SELECT *, CASE WHEN coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') <> role THEN 1 ELSE 0 END AS new FROM spoken),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM marked),
merged AS (SELECT conv_id, island, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM numbered GROUP BY ALL),
islands AS (SELECT conv_id, island, role, text FROM merged QUALIFY island BETWEEN min(CASE WHEN role = 'user' THEN island END) OVER (PARTITION BY conv_id) AND max(CASE WHEN role = 'user' THEN island END) OVER (PARTITION BY conv_id))"""


@query(f"WITH {ISLANDS} SELECT * FROM islands")
def history_islands(spark, sf_dir):
    return chat.islands(turns(spark, sf_dir))


@query(f"""
WITH {ISLANDS}, sys AS (SELECT conv_id, arg_min(text, turn) AS s FROM conversations WHERE role = 'system' GROUP BY ALL),
led AS (SELECT i.conv_id, island, CASE WHEN island = min(island) OVER (PARTITION BY i.conv_id) AND coalesce(s, '') <> '' THEN s || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text ELSE text END AS text
  FROM islands i LEFT JOIN sys ON sys.conv_id = i.conv_id)
SELECT conv_id, count(*) - 1 AS n_history, coalesce(string_agg(text, '|' ORDER BY island) FILTER (NOT last), '') AS history, any_value(text) FILTER (last) AS prompt
FROM (SELECT *, island = max(island) OVER (PARTITION BY conv_id) AS last FROM led) GROUP BY conv_id""")
def chat_prompt(spark, sf_dir):
    return chat.prompts(turns(spark, sf_dir)).select("conv_id", F.size("history").cast("long").alias("n_history"), F.array_join("history", "|").alias("history"), "prompt")


@query(f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND trim(coalesce(text, ''), {TRIM}) <> '') AS text FROM conversations GROUP BY ALL),
c AS (SELECT conv_id, regexp_replace(trim(text, {TRIM}), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g') AS t FROM f)
SELECT conv_id, CASE WHEN t IS NULL THEN 'New chat' WHEN length(t) > 40 THEN substr(t, 1, 40) || '...' ELSE t END AS title FROM c""")
def chat_titles(spark, sf_dir):
    return chat.titles(turns(spark, sf_dir))


@query(f"""
SELECT conv_id, turn, trim(regexp_replace(text, '(?i)/(?:diagram|visualization|viz)\\b', '', 'g'), {TRIM}) AS query,
  {' OR '.join(f"contains(lower(text), '{p}')" for p in chat.TOKEN_ERRORS)} AS asks_token, {' OR '.join(f"contains(lower(text), '{p}')" for p in chat.SETTING_ERRORS)} AS asks_settings,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x, {TRIM}), '^[0-9]+[.)]')))::BIGINT AS claims,
  trim(regexp_replace(text, '(?s)<think>.*?(?:</think>|$)', '', 'g'), {TRIM}) AS visible FROM conversations""")
def turn_parts(spark, sf_dir):
    text = F.col("text")
    return turns(spark, sf_dir).select(
        "conv_id", "turn", chat.without_flags(text).alias("query"), chat.says_any(text, chat.TOKEN_ERRORS).alias("asks_token"), chat.says_any(text, chat.SETTING_ERRORS).alias("asks_settings"),
        F.size(chat.claims(text)).cast("long").alias("claims"), chat.think_split(text)[1].alias("visible"),
    )
