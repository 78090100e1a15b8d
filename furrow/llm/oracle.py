"""DuckDB SQL that gives the rows of the pN_ queries where SQL can express them."""

from __future__ import annotations

from furrow.plans.sql import M as MANIFEST
from furrow.plans.sql import word as _word

_BLANK = r"[\s\p{Z}\x{200B}\x{FEFF}]"
_STEM = r"regexp_replace(regexp_replace(lower(regexp_replace(path, '^.*[/\\]', '')), '\.[^.]*$', ''), '(_hard[0-9]+|__dup[0-9]+)+$', '')"

P2_PAIRS = rf"""
k AS (SELECT *, {_STEM} AS photo FROM m),
pairs AS (
  SELECT t.path AS train_path, e.path AS eval_path, e.split, e.source_folder,
         CASE WHEN bit_count(xor(t.hash, e.hash)::BIT) <= 5 THEN bit_count(xor(t.hash, e.hash)::BIT) END AS bits
  FROM k t JOIN k e ON t.split = 'train' AND e.split IN ('val','test')
  WHERE bit_count(xor(t.hash, e.hash)::BIT) <= 5 OR (t.source_folder = e.source_folder AND t.photo = e.photo))"""

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS path, least(a, min(b)) AS root FROM reach GROUP BY a)"""

_NEEDS = """
e AS (SELECT * FROM m WHERE split = 'train' AND final_class IS NOT NULL AND NOT is_copy),
n AS (SELECT final_class, count(*) AS n_available FROM e GROUP BY final_class),
needs AS (
  SELECT p.plan_id, p.final_class, p.target_share, coalesce(p.min_rows, 0) AS min_rows, coalesce(n_available, 0) AS n_available,
         floor(CAST(sample_fraction AS DECIMAL(12,8)) * (SELECT count(*) FROM e)) AS sample_size
  FROM sample_plans p LEFT JOIN n ON p.final_class = n.final_class)"""

# The words of a text by the rule of TESTDATA: invisible characters go first, then markup (inline tags join), entities, escaped markup, single accents.
_UNSEEN = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0000}-\x{E0FFF}]"
_JOINING = r"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|label|mark|nobr|output|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)(?:[^A-Za-z0-9:_<>-][^<>]*)?>"
_ALONE = r"[\x{A8}\x{AF}\x{B4}\x{B8}\x{2D8}-\x{2DD}\x{37A}\x{384}\x{385}\x{1FBD}\x{1FBF}-\x{1FC1}\x{1FCD}-\x{1FCF}\x{1FDD}-\x{1FDF}\x{1FED}\x{1FEE}\x{1FFD}\x{1FFE}\x{2017}\x{203E}]"


def _without_tags(x: str) -> str:
    joined = f"regexp_replace(regexp_replace({x}, '<!--.*?-->', ' ', 'gs'), '{_JOINING}', '', 'gi')"
    return f"regexp_replace({joined}, '</?[A-Za-z][^<>]*>|<[!?][^<>]*>', ' ', 'g')"


def _words(x: str) -> str:
    out = _without_tags(f"regexp_replace({x}, '{_UNSEEN}', '', 'g')")
    out = f"regexp_replace({out}, '&(?:amp;)+', '&', 'gi')"
    for name, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&#39;": "''"}.items():
        out = f"replace({out}, '{name}', '{char}')"
    out = f"regexp_replace({_without_tags(out)}, '{_ALONE}', ' ', 'g')"
    return rf"regexp_extract_all(nfc_normalize(replace(lower({out}), 'ß', 'ss')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}]*')"


_ITEM_WORDS = _words("text")

_P5 = rf"""WITH RECURSIVE {MANIFEST},
spelt AS (SELECT regexp_replace(replace(regexp_replace(path_a, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '\', '/'), '^(\./+)+', '') AS a,
                 regexp_replace(replace(regexp_replace(path_b, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '\', '/'), '^(\./+)+', '') AS b
          FROM match_pairs WHERE {_word("verdict")} IN ('match','same')),
good AS (SELECT a, b FROM spelt WHERE a <> b AND a IN (SELECT path FROM m) AND b IN (SELECT path FROM m)),
edges AS (SELECT a, b FROM good UNION SELECT b, a FROM good UNION SELECT x.path, y.path FROM m x JOIN m y ON x.hash = y.hash AND x.path <> y.path), {_COMPONENTS}"""

_P7 = rf"""WITH i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM eval_items),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
found AS (SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g))"""

ORACLE: dict[str, str] = {
    "p1_found": """
WITH v AS (SELECT DISTINCT vec_id, x FROM features WHERE len(x) = 50 AND len(list_filter(x, lambda z: isfinite(z))) = 50 AND len(list_filter(x, lambda z: z <> 0)) > 0),
r AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 5""",
    "p2_found": f"WITH {MANIFEST}, {P2_PAIRS} SELECT DISTINCT least(train_path, eval_path) AS path_a, greatest(train_path, eval_path) AS path_b FROM pairs",
    "p2_report": f"""WITH {MANIFEST}, {P2_PAIRS}
SELECT split, source_folder, count(*) AS n_pairs, count(DISTINCT eval_path) AS n_eval, count(DISTINCT train_path) AS n_train, count(*) FILTER (bits = 0) AS n_exact
FROM pairs GROUP BY split, source_folder""",
    "p3_found": f"WITH {MANIFEST}, {_NEEDS} SELECT plan_id, final_class FROM needs WHERE n_available < min_rows OR n_available < CAST(target_share AS DECIMAL(12,8)) * CAST(sample_size AS DECIMAL(18,0))",
    "p3_rules": "SELECT DISTINCT plan_id, 0 AS n_repeated, 0 AS n_foreign, 0 AS n_classes_off, 0 AS n_sources_off FROM sample_plans WHERE sample_fraction > 0 AND target_share > 0",
    "p4_found": f"""WITH RECURSIVE {MANIFEST},
edges AS (SELECT a.path AS a, b.path AS b FROM m a JOIN m b ON a.path <> b.path AND bit_count(xor(a.hash, b.hash)::BIT) <= 5), {_COMPONENTS},
torn AS (SELECT root FROM comp JOIN m USING (path) GROUP BY root HAVING count(DISTINCT split) > 1)
SELECT path FROM comp WHERE root IN (SELECT root FROM torn)""",
    "p4_rules": f"WITH {MANIFEST} SELECT count(DISTINCT path) AS n_records, 0 AS n_unassigned, 0 AS n_repeated, 0 AS n_torn, 0 AS n_off FROM m",
    "p5_found": f"{_P5} SELECT root AS group_path, path FROM comp WHERE root <> path",
    "p5_groups": f"{_P5} SELECT m.path, coalesce(root, m.path) AS group_path FROM m LEFT JOIN comp ON comp.path = m.path",
    "p5_sizes": f"""{_P5}, g AS (SELECT coalesce(root, m.path) AS g, count(*) AS size FROM m LEFT JOIN comp ON comp.path = m.path GROUP BY 1)
SELECT size, count(*) AS n_groups FROM g GROUP BY size""",
    "p6_rules": "SELECT count(DISTINCT doc_id) AS n_items, 0 AS n_repeated, 0 AS n_incomplete, 0 AS n_needless, 0 AS n_over FROM documents WHERE text <> ''",
    "p7_found": f"{_P7} SELECT item_id, doc_id FROM found",
    "p7_report": f"""{_P7}, h AS (SELECT item_id, count(*) AS n FROM found GROUP BY 1)
SELECT item_set, split, count(*) AS n_items, count(n) AS n_leaked, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM eval_items LEFT JOIN h USING (item_id) GROUP BY 1, 2""",
}
