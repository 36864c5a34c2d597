"""DuckDB SQL fragments of the derived views and text expressions, used by the oracle.

They restate, in SQL, what the DataFrame code computes, with the same regex text.
"""

from __future__ import annotations

from textloom.functions.text import MENTION_PATTERN, URL_PATTERN, WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


POSTS = """posts AS (
  SELECT d.doc_id, d.lang AS dataset, d.text,
         CASE l.quality*2 + l.toxic WHEN 0 THEN 'minimum' WHEN 1 THEN 'mild'
              WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

def raw_gen(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT doc_id AS gen_id, dataset, coalesce(label, 'minimum') AS label,
         CASE CAST(doc_id % 6 AS INT)
           WHEN 0 THEN concat('Sure! <post>', text, '</post> bye')
           WHEN 1 THEN concat('<post>', text)
           WHEN 2 THEN concat('User: x Assistant: ', text)
           WHEN 3 THEN concat('"', text, '"')
           WHEN 4 THEN concat('[INST] p [/INST] ', text)
           ELSE text END AS raw_text
  FROM {src})"""


RAW_GEN = raw_gen("posts", "raw_gen")

LOGITS = """cent_x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent_m AS (SELECT label, pos, avg(x) AS m FROM cent_x GROUP BY label, pos),
cent AS (SELECT label, list(m ORDER BY pos) AS c FROM cent_m GROUP BY label),
logits AS (
  SELECT e.vec_id, e.label AS label_id, list(list_dot_product(c.c, CAST(e.embedding AS DOUBLE[])) ORDER BY c.label) AS l
  FROM embeddings e, cent c GROUP BY e.vec_id, e.label)"""


def mask_urls(c: str) -> str:
    return f"regexp_replace({c}, {q(URL_PATTERN)}, ' <URL> ', 'g')"


def mask_mentions(c: str) -> str:
    return f"regexp_replace({c}, {q(MENTION_PATTERN)}, ' <USER> ', 'g')"


def collapse_ws(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'))"


def clean_text(c: str) -> str:
    s = f"translate(CAST({c} AS VARCHAR), chr(10) || chr(9), '')"
    return collapse_ws(f"lower({mask_mentions(mask_urls(s))})")


def strip_ws(c: str) -> str:
    return f"regexp_replace({c}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def word_count(c: str) -> str:
    s = collapse_ws(c)
    return f"CASE WHEN length({s}) = 0 THEN 0 ELSE len(string_split({s}, ' ')) END"


def seeded_hash(seed, *cols: str) -> str:
    inner = ", '|', ".join([q(str(seed))] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5(concat({inner})), 1, 15)) AS BIGINT)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
