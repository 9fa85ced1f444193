"""DuckDB SQL for the queries that SQL can express; tests/llm holds the others against plain versions."""

from __future__ import annotations

from . import mixing, secrets, urlfilter, vectordedup


def _op1() -> str:
    parts, lists = [], []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"[length(x) FOR x IN regexp_split_to_array(t, '{p}')] AS gap{rank}, [length(x) FOR x IN regexp_extract_all(t, '{p}', 0)] AS size{rank}, [length(x) FOR x IN regexp_extract_all(t, '{p}', {r.group})] AS value{rank}")
        start = f"(list_sum(gap{rank}[1:i]) + coalesce(list_sum(size{rank}[1:i - 1]), 0))::BIGINT"
        lists.append(f"[{{'s': {start}, 'r': {rank}, 'k': '{r.kind}', 'e': {start} + size{rank}[i]}} FOR i IN range(1, len(size{rank}) + 1) IF value{rank}[i] >= {r.least}]")
    listed = "array_to_string([x.k || ':' || x.s || ':' || x.e FOR x IN f IF {}], ',')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(parts)} FROM d), a AS (SELECT doc_id, list_sort(flatten([{', '.join(lists)}])) AS f FROM m) "
        f"SELECT doc_id, {', '.join(f'len([x FOR x IN f IF x.r = {i}]) AS n_{k}' for i, k in enumerate(('assign', 'access', 'hex')))}, sha256({listed.format('x.r < 3')}) AS base_sha256, {listed.format('true')} AS spans FROM a"
    )


def _op3() -> str:
    t = vectordedup.THRESHOLD
    x = "list_transform(embedding, lambda c: c::DOUBLE)"
    return (
        f"WITH RECURSIVE v AS (SELECT vec_id, {x} AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter({x}, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform({x}, lambda c: abs(c))) > 0), "
        f"e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {t}), "
        "r AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i), c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i), n AS (SELECT i, count(*) AS n FROM e GROUP BY i) "
        "SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN c ON c.i = vec_id LEFT JOIN n ON n.i = vec_id"
    )


def _op6() -> str:
    rows = sorted(urlfilter.HOST_RULES, key=lambda r: -len(r.name))
    fits = []
    for r in rows:
        host, _, rest = r.name.partition("/")
        fits.append((r, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"))
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.name}'" for r, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in fits)
    verdict += " " + " ".join(f"WHEN regexp_matches(host || path, '(?s){r.pattern}') THEN '{r.verdict}'" for r in urlfilter.PATTERN_RULES) + " ELSE 'allow' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM u"


def _op7() -> str:
    w = ", ".join(f"{x:.1f}" for x in mixing.WEIGHTS)
    return (
        f"WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS draw FROM documents), "
        "s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), "
        f"r AS (SELECT *, [{w}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight, source_size * {float(mixing.MAX_EPOCHS)} AS cap, cap / weight AS ratio FROM s), "
        "l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        "f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio), "
        "g AS (SELECT source, source_size, least(f.level * weight, cap) AS target FROM l, f), t AS (SELECT source, source_size, target, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole, goal - whole * source_size AS rest FROM g), "
        "o AS (SELECT d.doc_id, d.size, t.*, coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY draw, d.doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source) "
        "SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM o"
    )


def _op8() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    runs = [f"('0x' || substr(h, {5 * i + 1}, 5))::BIGINT" for i in range(8)]
    digest = " || ".join(f"substr('{letters}', ((({x}) >> {shift}) & 31)::INT + 1, 1)" for x in runs for shift in (15, 10, 5, 0))
    return (
        f"WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {digest} AS payload_digest FROM p), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d) "
        "SELECT page_id, payload_bytes, payload_digest, CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to FROM m"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": _op1(), "op3_embeddings": _op3(), "op6_url_filters": _op6(), "op7_mixing": _op7(), "op8_warc": _op8()}
