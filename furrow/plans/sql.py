"""Common table expressions of the checking SQL: the tables with cells in one spelling."""

from __future__ import annotations


def word(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g'))"


def cls(c: str) -> str:
    return rf"nullif(regexp_replace({word(c)}, '[\s\p{{Z}}\x{{200B}}\x{{FEFF}}_-]+', '_', 'g'), '')"


_HEX = rf"regexp_replace(regexp_replace(lower(dhash), '[\s\p{{Z}}\x{{200B}}\x{{FEFF}}:_.,-]', '', 'g'), '^0x', '')"

M = rf"""m0 AS (
  SELECT path, source_folder, {word("split")} AS s, {cls("final_class")} AS final_class,
         {word("is_dup_copy")} AS w, {word("dup_source")} AS o, {_HEX} AS digits FROM manifest WHERE path IS NOT NULL),
m AS (SELECT DISTINCT path, final_class, source_folder,
    CASE WHEN s IN ('train','training') THEN 'train' WHEN s IN ('val','valid','validation') THEN 'val' WHEN s IN ('test','testing') THEN 'test' END AS split,
    coalesce(w IN ('true','t','1','yes','y'), false) OR coalesce(o <> '', false) AS is_copy,
    CASE WHEN regexp_full_match(digits, '[0-9a-f]{{1,16}}') THEN CAST('0x' || digits AS UBIGINT) END AS hash FROM m0)"""

P = rf"""p AS (SELECT DISTINCT run_tag, path, {cls("true_class")} AS true_class, {cls("pred")} AS pred,
    CASE WHEN {word("is_plantvillage")} <> '' THEN {word("is_plantvillage")} IN ('true','t','1','yes','y') END AS studio,
    CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence FROM predictions)"""

FS = rf"f AS (SELECT DISTINCT path, name, p_strawberry AS p, {cls('bucket')} AS bucket FROM filter_scores)"

V = rf"""v AS (SELECT vec_id, min(r).label AS label, min(r).x AS x FROM (
    SELECT vec_id, {{'label': {cls("y")}, 'x': x}} AS r FROM features
    WHERE vec_id IS NOT NULL AND len(x) = 50 AND len(list_filter(x, lambda z: isfinite(z))) = 50 AND {cls("y")} IS NOT NULL) GROUP BY vec_id)"""


def base(c: str) -> str:
    return rf"regexp_replace({c}, '^.*[/\\]', '')"


def stem(c: str) -> str:
    return rf"regexp_replace({base(c)}, '\.[^.]*$', '')"


def md5_order(c: str, seed: int) -> str:
    return f"md5(CAST({c} AS VARCHAR) || ':{seed}')"
