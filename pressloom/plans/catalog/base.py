"""Registry of checked queries, and the SQL fragments their DuckDB counterparts share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressloom.functions import fixed_values as fv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


NOW = "TIMESTAMP '2024-01-30 00:00:00'"
UNICODE_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def fold1(x: str) -> str:
    return f"strip_accents(lower({x}))"


def fold2(x: str) -> str:
    singles = "".join(fv.RETRIEVAL_ACCENTS.values())
    bases = "".join(b * len(f) for b, f in fv.RETRIEVAL_ACCENTS.items())
    out = f"translate(lower({x}), '{singles}', '{bases}')"
    for ligature, letters in fv.RETRIEVAL_LIGATURES.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    return rf"regexp_replace(regexp_replace({out}, '[\x{{300}}-\x{{36f}}]', '', 'g'), '[^\x00-\x7f]', ' ', 'g')"


def tokens1(x: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all({fold1(x)}, '[a-z0-9]+')), "
        f"lambda w: length(w) >= 4 AND w NOT IN ({quoted(fv.GROUPING_STOP_WORDS)}))"
    )


def tokens2(x: str, generic: bool = True) -> str:
    stop = fv.RETRIEVAL_STOP_WORDS + ([] if generic else fv.GENERIC_TERMS)
    return (
        f"list_filter(list_distinct(regexp_extract_all({fold2(x)}, '[a-z0-9]+')), "
        f"lambda w: (length(w) >= 4 OR w IN ({quoted(fv.RETRIEVAL_SHORT_TERMS)})) AND w NOT IN ({quoted(stop)}))"
    )


def topic_terms(x: str) -> str:
    return tokens2(x, generic=False)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{UNICODE_SPACE}', ' ', 'g'))"


NAMED = {"nbsp": " ", "middot": "·", "copy": "©", "lt": "<", "gt": ">", "quot": '"', "#39": "''", "amp": "&"}


def clean(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in NAMED.items():
        out = f"replace({out}, '&{name};', '{char}')"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]', '', 'g')"
    return squeeze(out)


def short(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(regexp_replace(substr({x}, 1, {n}), ' [^ ]*$', ''), ',;:.- ') || '…' END"


def outlet_key(url: str) -> str:
    h = host(url)
    second = quoted(fv.PUBLIC_SECOND_LEVELS)
    parts = f"string_split({h}, '.')"
    return (
        f"CASE WHEN len({parts}) <= 2 THEN {h} "
        f"WHEN length({parts}[-1]) = 2 AND {parts}[-2] IN ({second}) THEN array_to_string({parts}[-3:], '.') "
        f"ELSE array_to_string({parts}[-2:], '.') END"
    )


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def local(ts: str) -> str:
    return f"({ts} - INTERVAL 3 HOUR)"


def day(ts: str) -> str:
    return f"strftime({local(ts)}, '%Y-%m-%d')"


RAW = f"""raw AS (SELECT doc_id, source, lang, n_chars, split_part(text, chr(10), 1) AS raw_title,
    regexp_replace(text, '^[^\\n]*\\n?', '') AS raw_desc,
    {NOW} - to_minutes(doc_id * 37 % 20160) AS published, CAST(substr(source, 4) AS INT) AS n FROM documents)"""

HEADLINES = f"""{RAW},
cleaned AS (SELECT *, {clean('raw_title')} AS ct, {clean('raw_desc')} AS cd,
    'https://' || source || '.example.org/' || lang || '/' || doc_id AS url FROM raw),
h AS MATERIALIZED (SELECT doc_id, substr(sha1(url), 1, 12) AS id, {short('ct', 300)} AS title, {short('cd', 260)} AS "desc", url, source,
    CASE WHEN n < 2 THEN 'checagem' ELSE 'noticia' END AS kind,
    CASE WHEN n < 2 THEN 'checagem' WHEN n < 4 THEN 'oficial' WHEN n < 10 THEN 'nacional' ELSE 'regional' END AS grupo,
    published, lang, raw_desc AS body, n FROM cleaned)"""

SOURCES = """src AS (SELECT DISTINCT source AS id, 'Outlet ' || CAST(substr(source, 4) AS INT) AS name,
    CASE WHEN CAST(substr(source, 4) AS INT) < 2 THEN 'checagem' ELSE 'noticia' END AS kind,
    'https://www.' || source || '.example.org/home' AS home,
    CASE WHEN CAST(substr(source, 4) AS INT) < 2 THEN 'checagem' WHEN CAST(substr(source, 4) AS INT) < 4 THEN 'oficial'
         WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'nacional' ELSE 'regional' END AS grupo,
    CASE WHEN CAST(substr(source, 4) AS INT) >= 10 THEN n_name ELSE '' END AS uf, CAST(substr(source, 4) AS INT) AS n
    FROM documents LEFT JOIN nation ON n_nationkey = CAST(substr(source, 4) AS INT))"""
