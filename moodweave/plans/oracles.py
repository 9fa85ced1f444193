"""DuckDB SQL that states the registered queries a second time, from the tables alone."""

from __future__ import annotations

from ..functions.text import DASHES, IRREGULAR, QUOTES, SUFFIXES
from ..operators.chunking import CASE_MARK, HEADERS
from ..operators.lexicon import EMOTIONS
from .catalogue import FILE_NAMES, STOP_PHRASES

_FROM, _TO = QUOTES + DASHES, "''" * len(QUOTES) + "-" * len(DASHES)
WORDS = f"regexp_extract_all(lower(translate(coalesce(text, ''), '{_FROM}', '{_TO}')), '\\p{{L}}+(?:[''-]\\p{{L}}+)*')"
ARR = f"arr AS (SELECT doc_id, text, {WORDS} AS ts FROM documents)"
TOK = ARR + ", tok AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM arr)"
VOC = TOK + ", voc AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term)"
RANKED = VOC + ", rk AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) AS rank FROM voc WHERE length(term) >= 2 QUALIFY rank <= 830)"
_ENTRY = "((rank * 37) % 201 - 100) / 100.0 AS v, ((rank * 53) % 201 - 100) / 100.0 AS a, ((rank * 71) % 201 - 100) / 100.0 AS d, (rank % 101) / 100.0 AS intensity, CASE WHEN rank % 5 = 0 THEN 2 ELSE 1 END AS shared"
LEX = RANKED + f", lex AS (SELECT term, rank, rank % 8 AS emotion, {_ENTRY} FROM rk WHERE rank > 30 UNION ALL SELECT term, rank, (rank * 3 + 1) % 8, {_ENTRY} FROM rk WHERE rank > 30 AND rank % 5 = 0), terms AS (SELECT DISTINCT term, rank, v, a, d FROM lex)"
COUNTS = LEX + ", cnt AS (SELECT doc_id, emotion, sum(840 // shared) / 840 AS count, count(*) AS hits FROM tok JOIN lex USING (term) GROUP BY ALL)"
_VECTOR = ", ".join(f"coalesce(max(count) FILTER (emotion = {e}), 0.0)" for e in range(8))
PROF = COUNTS + (
    f", vec AS (SELECT doc_id, [{_VECTOR}] AS c, sum(hits)::BIGINT AS lex_hits FROM cnt GROUP BY doc_id)"
    ", prof AS (SELECT arr.doc_id, len(ts) AS n_words, coalesce(lex_hits, 0) AS lex_hits, coalesce(c, [0.0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[]) AS c, list_sum(coalesce(c, [0.0]::DOUBLE[])) AS mass, mass / greatest(len(ts), 1) * 1000 AS rate FROM arr LEFT JOIN vec USING (doc_id))"
)
_NORM = "CASE WHEN list_sum({x}) > 0 THEN list_transform({x}, lambda e: e / list_sum({x})) ELSE list_transform({x}, lambda e: 1.0 / len({x})) END"
_ENTROPY = "-list_sum(list_transform({p}, lambda e: greatest(e, 1e-8) * ln(greatest(e, 1e-8)))) / ln(8.0)"
CAL = PROF + (
    ", guess AS (SELECT *, [c[i] + i / 8.0 FOR i IN range(1, 9)] AS g, CASE WHEN rate > 0 THEN rate / (rate + 20) ELSE 0.0 END AS s FROM prof)"
    ", mixed AS (SELECT *, CASE WHEN s > 0 THEN [(1 - s) * g[i] / list_sum(g) + s * c[i] / mass FOR i IN range(1, 9)] ELSE [x / list_sum(g) FOR x IN g] END AS m, (1 - s) * list_sum(g) + s * mass AS cal_mass FROM guess)"
    f", cal AS (SELECT *, {_NORM.format(x='m')} AS p FROM mixed)"
)
MEASURED = CAL + ", xs AS (SELECT doc_id, [greatest(e * rate / 100, 1e-8) FOR e IN p] AS x FROM cal WHERE lex_hits > 0)"
_CONF = "vad AS (SELECT term, avg(v) AS v, avg(a) AS a, avg(d) AS d, CASE WHEN any_value(rank) % 3 = 0 THEN 1.0 ELSE 0.5 END AS conf, any_value(rank) AS rank FROM lex GROUP BY term)"
WINDOWS = ARR + ", win AS (SELECT doc_id, ts, s.start AS start, ts[s.start + 1 : s.start + 64] AS w FROM (SELECT doc_id, ts, unnest(range(0, (CASE WHEN len(ts) <= 64 THEN 0 ELSE ceil((len(ts) - 64) / 48.0) * 48 END)::BIGINT + 1, 48)) AS start FROM arr) s)"
LINES = "line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
_LETTERS, _UPPER = "length(regexp_replace(line, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(line, '[^\\p{Lu}]', '', 'g'))"
_CAPS = f"({_LETTERS} >= 6 AND {_UPPER} >= 0.7 * {_LETTERS})"
_NUMBER, _LABEL = "regexp_matches(trim(line), '^([0-9]+|(?i:[ivxlcdm]{1,8}))$')", "regexp_matches(trim(line), '(?i)^(page|pp?\\.?)\\s*\\d{1,4}$')"
_TOC = "(regexp_matches({x}, '(?i)(\\.{{2,}}|\\s+)(\\d{{1,4}}|[ivxlcdm]{{1,8}})\\s*$') OR (contains({x}, '..') AND regexp_matches(rtrim({x}), '[.)]$')) OR regexp_matches({x}, '^\\d{{1,3}}[.)]\\s+'))"

_KAPPA, _TAU, _REG = "exp(-10.0)", "(0.5 / 0.6)", "0.5"


def _scaled(side: str, other: str) -> str:
    """One half step: the measure over what the kernel (1 on the diagonal, kappa off it) makes of the other scaling."""
    return f"list_transform(list_zip({side}, {other}), lambda e: pow(e[1] / ({_KAPPA} * list_sum({other}) + (1 - {_KAPPA}) * e[2]), {_TAU}))"


def _marginal(own: str, other: str) -> str:
    return f"list_transform(list_zip({own}, {other}), lambda e: e[1] * ({_KAPPA} * list_sum({other}) + (1 - {_KAPPA}) * e[2]))"


def _kl(p: str, q: str) -> str:
    return f"list_sum(list_transform(list_zip({p}, {q}), lambda e: greatest(e[1], 1e-8) * (ln(greatest(e[1], 1e-8)) - ln(greatest(e[2], 1e-8))) - greatest(e[1], 1e-8) + greatest(e[2], 1e-8)))"


SOLVED = (
    ", sk AS (SELECT 0 AS k, i, j, a, b, a AS u, [1.0, 1, 1, 1, 1, 1, 1, 1]::DOUBLE[] AS v FROM pairs UNION ALL "
    f"SELECT k + 1, i, j, a, b, u2, {_scaled('b', 'u2')} FROM (SELECT k, i, j, a, b, {_scaled('a', 'v')} AS u2 FROM sk WHERE k < 30) t)"
    f", marg AS (SELECT i, j, a, b, u, v, {_KAPPA} * (list_sum(u) * list_sum(v) - list_dot_product(u, v)) AS transport, {_marginal('u', 'v')} AS pa, {_marginal('v', 'u')} AS pb FROM sk WHERE k = 30)"
    f", solved AS (SELECT *, {_kl('pa', 'a')} AS kl_a, {_kl('pb', 'b')} AS kl_b FROM marg), cost AS (SELECT *, transport + {_REG} * (kl_a + kl_b) AS cost FROM solved)"
)
MEAN = MEASURED + f", mean AS (SELECT [{', '.join(f'greatest((SELECT avg(e * rate / 100) FROM (SELECT p[{i}] AS e, rate FROM cal WHERE lex_hits > 0)), 1e-8)' for i in range(1, 9))}] AS x)"
CENTROIDS = "e AS (SELECT label, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS dim FROM embeddings), mn AS (SELECT label, dim, avg(value) AS m FROM e GROUP BY ALL), cen AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value FROM mn), ref AS (SELECT label AS ref, list(value ORDER BY dim) AS c FROM cen GROUP BY label)"
KNN = "q AS (SELECT vec_id AS i, label AS il, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT i, il, vec_id AS j, label AS jl, (1 - list_dot_product(x, embedding::DOUBLE[]) / sqrt(list_dot_product(x, x) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) / 2 AS distance FROM q, embeddings WHERE vec_id <> i), nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM d)"


def _lemmas() -> str:
    found = ["CASE term " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items()) + " END"]
    for ending, least, instead in SUFFIXES:
        fits = f"ends_with(term, '{ending}') AND length(term) >= {least}" + (" AND NOT ends_with(term, 'ss')" if ending == "s" else "")
        stem = f"left(term, length(term) - {len(ending)})"
        if instead is not None:
            found.append(f"CASE WHEN {fits} THEN {stem} || '{instead}' END")
        else:
            found += [f"CASE WHEN {fits} THEN {stem} END", f"CASE WHEN {fits} AND NOT ends_with({stem}, 'e') THEN {stem} || 'e' END", f"CASE WHEN {fits} AND length({stem}) >= 2 AND right({stem}, 1) = substr({stem}, length({stem}) - 1, 1) THEN left({stem}, length({stem}) - 1) END"]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def _strip() -> tuple[str, str]:
    text, hits = "coalesce(text, '')", []
    for phrase in sorted(STOP_PHRASES, key=lambda p: (-len(p), p)):
        pattern = "(?i)\\b" + "\\s+".join(phrase.split()) + "\\b"
        hits.append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return text, " + ".join(hits)


_STRIPPED, _HITS = _strip()
_RATES = ", rates AS (SELECT doc_id, unnest(range(8)) AS emotion, unnest([round(e / greatest(n_words, 1) * 1000, 6) FOR e IN c]) AS rate FROM prof)"
_NAMES = " UNION ALL ".join(f"SELECT '{p}' AS path" for p in FILE_NAMES)
_R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)

ORACLES = {
    "entry_profile": f"WITH {PROF}, n AS (SELECT *, {_NORM.format(x='c')} AS p FROM prof) SELECT doc_id, n_words, lex_hits, {', '.join(f'round(p[{i + 1}], 6) AS {e}' for i, e in enumerate(EMOTIONS))}, round({_ENTROPY.format(p='p')}, 6) AS entropy FROM n",
    "tok_word_counts": f"WITH {ARR} SELECT doc_id, len(ts) AS n_words, len(list_distinct(ts)) AS n_distinct FROM arr",
    "tok_df_idf": f"WITH {VOC} SELECT term, df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM voc",
    "tok_tfidf_topk": f"WITH {VOC}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 GROUP BY ALL), w AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)) SELECT doc_id, term, tf, round(w, 6) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY w.w DESC, term DESC) AS rank FROM w QUALIFY rank <= 5",
    "tok_drop_top_df": f"WITH {VOC}, v2 AS (SELECT * FROM voc WHERE length(term) >= 2), common AS (SELECT term FROM v2 WHERE (SELECT count(*) FROM v2) > 100 ORDER BY df DESC, term DESC LIMIT 100) SELECT doc_id, count(*) AS n_kept, count(DISTINCT term) AS n_terms FROM tok WHERE length(term) >= 2 AND term NOT IN (SELECT term FROM common) GROUP BY doc_id",
    "tok_coverage_stats": f"WITH {LEX}, s AS (SELECT arr.doc_id, any_value(len(ts)) AS n_raw, count(terms.term) AS n_selected FROM arr LEFT JOIN tok ON tok.doc_id = arr.doc_id LEFT JOIN terms ON terms.term = tok.term GROUP BY arr.doc_id), r AS (SELECT *, n_selected / greatest(n_raw, 1) AS ratio FROM s) SELECT count(*) AS docs, sum(n_raw)::BIGINT AS n_raw, sum(n_selected)::BIGINT AS n_selected, count(*) FILTER (n_selected = 0) AS docs_with_zero, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY ratio DESC), 6) AS ratio_median, round(sum(n_selected) / greatest(sum(n_raw), 1), 6) AS coverage_total FROM r",
    "text_line_predicates": f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_CAPS}) AS n_caps, count(*) FILTER ({_NUMBER}) AS n_page_number, count(*) FILTER ({_LABEL}) AS n_page_label, count(*) FILTER ({_TOC.format(x='trim(line)')}) AS n_toc FROM line GROUP BY doc_id",
    "text_repeated_lines": f"WITH {LINES}, n AS (SELECT doc_id, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS norm FROM line) SELECT doc_id, norm, count(*) AS n FROM n WHERE length(norm) >= 6 GROUP BY ALL HAVING count(*) >= 3",
    "text_token_windows": f"WITH {WINDOWS} SELECT doc_id, start, len(w) AS n_tokens, w[1] AS first_term, w[-1] AS last_term FROM win",
    "text_stopphrase_strip": f"SELECT doc_id, {_HITS} AS hits, length({_STRIPPED}) AS n_left FROM documents",
    "text_context_snippet": f"WITH {LEX}, f AS (SELECT doc_id, min(pos) AS pos FROM tok JOIN terms USING (term) GROUP BY doc_id) SELECT doc_id, ts[pos + 1] AS term, pos, array_to_string(ts[greatest(pos - 3, 0) + 1 : pos + 4], ' ') AS snippet FROM f JOIN arr USING (doc_id)",
    "text_lemma_candidates": f"WITH {VOC}, c AS (SELECT term, CASE WHEN length(term) >= 3 THEN {_lemmas()} ELSE [] END AS l FROM voc), e AS (SELECT term, unnest(l) AS lemma, unnest(range(len(l))) AS place FROM c) SELECT term, arg_min(lemma, place) AS lemma, min(place) AS place FROM e WHERE lemma IN (SELECT term FROM voc) GROUP BY term",
    "range_merge_islands": "WITH r AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS s, floor(epoch(ts) / 3600)::BIGINT + event_id % 30 AS e FROM events), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM g GROUP BY user_id, island",
    "lex_counts_prior": f"WITH {COUNTS} SELECT doc_id, emotion, round(count, 6) AS count, hits, round(cnt.count / sum(cnt.count) OVER (PARTITION BY doc_id), 6) AS prior FROM cnt",
    "lex_negated_counts": f"WITH {LEX}, m AS (SELECT doc_id, pos, term, max(CASE WHEN rank IN (10, 20) THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS neg, max(CASE WHEN rank IN (15, 25) THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bound FROM tok LEFT JOIN rk USING (term)) SELECT doc_id, count(*) AS hits, count(*) FILTER (neg IS NOT NULL AND coalesce(bound, -1) < neg) AS negated_hits FROM m JOIN terms USING (term) GROUP BY doc_id",
    "lex_vad_average": f"WITH {LEX} SELECT doc_id, " + ", ".join(f"(((sum(round({c} * 100)::BIGINT)::BIGINT + 100 * count(*)) * 20000 + count(*)) // (2 * count(*)) - 1000000) / 1000000.0::DOUBLE AS {c}" for c in "vad") + ", count(*) AS vad_hits FROM tok JOIN terms USING (term) GROUP BY doc_id",
    "lex_prototypes": f"WITH {LEX} SELECT emotion, count(*) AS n, round(avg(v), 6) AS v, round(avg(a), 6) AS a, round(avg(d), 6) AS d FROM lex GROUP BY emotion",
    "lex_term_vad_conf": f"WITH {LEX}, {_CONF}, imp AS (SELECT term, 0 - v AS v, 0 - a AS a, 0 - d AS d, rank % 10 / 10 AS conf FROM terms WHERE rank % 7 = 0), j AS (SELECT vad.*, imp.v AS iv, imp.a AS ia, imp.d AS id, imp.conf AS iconf, imp.term IS NOT NULL AND imp.conf > vad.conf AS w FROM vad LEFT JOIN imp USING (term)) SELECT term, round(CASE WHEN w THEN iv ELSE v END, 6) AS v, round(CASE WHEN w THEN ia ELSE a END, 6) AS a, round(CASE WHEN w THEN id ELSE d END, 6) AS d, round(CASE WHEN w THEN iconf ELSE conf END, 6) AS conf, w::INT AS was_imputed FROM j",
    "lex_filters": f"WITH {LEX}, {_CONF}, voc2 AS (SELECT term FROM vad WHERE CASE WHEN length(term) % 2 = 0 THEN conf < 1 OR greatest(abs(v), least(greatest(a, 0), 1)) >= 0.45 ELSE abs(v) >= 0.45 AND least(greatest(a, 0), 1) >= 0.45 END) SELECT term, emotion, (term IN (SELECT term FROM voc2))::INT AS emotional FROM lex WHERE intensity >= 0.2 AND greatest(least(abs(v), 1), least(greatest(a, 0), 1)) >= 0.3 AND a >= -0.5",
    "lex_term_weights": f"WITH {LEX}, i AS (SELECT term, max(intensity) AS i FROM lex WHERE rank % 2 = 0 GROUP BY term), s AS (SELECT term, max(greatest(least(abs(v), 1), least(greatest(a, 0), 1))) AS s FROM lex WHERE rank % 3 = 0 GROUP BY term) SELECT term, round(greatest(0.05, least(1.0, (0.6 * coalesce(i, 0) + 0.4 * coalesce(s, 0)) / 1.0)), 6) AS weight FROM i FULL JOIN s USING (term)",
    "vad_scale_detect": f"WITH {LEX}, x AS (SELECT unnest([(v + 1) / 2, (a + 1) / 2, (d + 1) / 2]) AS x FROM terms), s AS (SELECT min(x) AS least, max(x) AS most, avg(x) AS mean FROM x) SELECT round(least, 6) AS least, round(most, 6) AS most, round(mean, 6) AS mean, round(s.most - s.least, 6) AS span, CASE WHEN s.least >= -1e-6 AND s.most <= 1.000001 THEN CASE WHEN s.most - s.least >= 0.5 AND s.mean BETWEEN 0.25 AND 0.75 THEN 'zero_one' ELSE 'signed' END ELSE 'signed' END AS mode FROM s",
    "score_calibrated": f"WITH {CAL} SELECT doc_id, round(mass, 6) AS lex_mass, round(rate, 6) AS lex_per_1k_words, round(s, 6) AS lex_strength, round({_ENTROPY.format(p='p')}, 6) AS pred_entropy_calibrated, round(cal_mass, 6) AS pred_counts_calibrated_mass FROM cal",
    "score_signal_gate": f"WITH {CAL}, g AS (SELECT doc_id, n_words, rate, lex_hits < 40 AND mass / greatest(n_words, 1) < 0.15 AS st, mass / greatest(n_words, 1) < 0.15 AND {_ENTROPY.format(p='p')} >= 0.99 AS un FROM cal) SELECT doc_id, st::INT AS strict_low, (st OR un)::INT AS low, CASE WHEN n_words < 20 THEN 'few_words' WHEN st OR un THEN 'flagged' ELSE 'kept' END AS reason, round(rate, 6) AS signal FROM g",
    "score_chunk_to_doc": f"WITH {WINDOWS}, c AS (SELECT doc_id, len(w) AS body, CASE WHEN start = 0 THEN len(w) ELSE greatest(len(w) - 16, 1) END AS fresh, list_sum([length(t) FOR t IN w])::DOUBLE AS letters FROM win WHERE len(w) > 0) SELECT doc_id, count(*) AS n_chunks, sum(fresh)::BIGINT AS n_tokens, round(sum(letters / body * fresh) / sum(fresh), 6) AS mean_length, round(sum(letters * fresh / body), 6) AS letters FROM c GROUP BY doc_id",
    "measure_per_1k": f"WITH {PROF}{_RATES} SELECT doc_id, emotion, rate FROM rates",
    "ot_doc_neighbours": f"WITH RECURSIVE {MEASURED}, qs AS (SELECT q.doc_id AS i, r.doc_id AS j, q.x AS a, r.x AS b FROM xs q, xs r WHERE q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id), pairs AS (SELECT * FROM qs UNION ALL SELECT j, i, b, a FROM qs WHERE NOT (j % 50 = 0) UNION ALL SELECT doc_id, doc_id, x, x FROM xs){SOLVED}, s AS (SELECT i, cost FROM cost WHERE i = j), d AS (SELECT c.i, c.j, (c.cost + r.cost) / 2 - s1.cost / 2 - s2.cost / 2 AS distance FROM cost c JOIN cost r ON c.i = r.j AND c.j = r.i JOIN s s1 ON s1.i = c.i JOIN s s2 ON s2.i = c.j WHERE c.i % 50 = 0 AND c.i <> c.j) SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d.distance, j) AS rank, round(distance, 6) AS distance FROM d QUALIFY rank <= 5",
    "ot_compare_rows": f"WITH RECURSIVE {PROF}, xs AS (SELECT doc_id, [greatest(e / greatest(n_words, 1) * 1000, 1e-8) FOR e IN c] AS x, [e / greatest(n_words, 1) * 1000 FOR e IN c] AS raw FROM prof WHERE lex_hits > 0), qs AS (SELECT q.doc_id AS i, r.doc_id AS j, q.x AS a, r.x AS b FROM xs q, xs r WHERE q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id), pairs AS (SELECT * FROM qs UNION ALL SELECT j, i, b, a FROM qs WHERE NOT (j % 50 = 0) UNION ALL SELECT doc_id, doc_id, x, x FROM xs){SOLVED}, s AS (SELECT i, cost FROM cost WHERE i = j), d AS (SELECT c.i, c.j, (c.cost + r.cost) / 2 - s1.cost / 2 - s2.cost / 2 AS distance FROM cost c JOIN cost r ON c.i = r.j AND c.j = r.i JOIN s s1 ON s1.i = c.i JOIN s s2 ON s2.i = c.j WHERE c.i % 50 = 0 AND c.i <> c.j), n AS (SELECT i, j, d.distance AS dist, row_number() OVER (PARTITION BY i ORDER BY d.distance, j) AS rank FROM d QUALIFY rank <= 3) SELECT i, j, rank, round(dist, 6) AS distance, round(abs(list_sum(y.raw) - list_sum(z.raw)), 6) AS mass_diff, list_position([abs(y.raw[k] - z.raw[k]) FOR k IN range(1, 9)], list_max([abs(y.raw[k] - z.raw[k]) FOR k IN range(1, 9)])) - 1 AS top_emotion FROM n JOIN xs y ON y.doc_id = j JOIN xs z ON z.doc_id = i",
    "ot_doc_unbalanced_parts": f"WITH RECURSIVE {MEAN}, pairs AS (SELECT doc_id AS i, -1 AS j, xs.x AS a, mean.x AS b FROM xs, mean UNION ALL SELECT -1, doc_id, mean.x, xs.x FROM xs, mean UNION ALL SELECT doc_id, doc_id, x, x FROM xs UNION ALL SELECT -1, -1, x, x FROM mean){SOLVED}, s AS (SELECT i, cost FROM cost WHERE i = j) SELECT c.i AS doc_id, round(c.transport, 6) AS transport, round(c.kl_a, 6) AS kl_a, round(c.kl_b, 6) AS kl_b, round(list_sum(c.a), 6) AS mass_a, round(list_sum(c.b), 6) AS mass_b, round(list_sum(c.pa), 6) AS mass_plan, round((c.cost + r.cost) / 2 - s.cost / 2 - (SELECT cost FROM s WHERE i = -1) / 2, 6) AS distance FROM cost c JOIN cost r ON r.i = -1 AND r.j = c.i JOIN s ON s.i = c.i WHERE c.j = -1 AND c.i <> -1",
    "ot_top_flows": f"WITH RECURSIVE {MEAN}, pairs AS (SELECT doc_id AS i, -1 AS j, xs.x AS a, mean.x AS b FROM xs, mean){SOLVED}, f AS (SELECT i, p, q, u[p] * v[q] * {_KAPPA} AS mass FROM cost, range(1, 9) t1(p), range(1, 9) t2(q) WHERE p <> q) SELECT i AS doc_id, row_number() OVER (PARTITION BY i ORDER BY f.mass DESC, p, q) AS rank, round(mass, 6) AS mass, round(f.mass, 6) AS contribution FROM f QUALIFY rank <= 3",
    "ot_style_deltas": f"WITH {PROF}, r AS (SELECT doc_id, unnest(range(8)) AS emotion, unnest([e / greatest(n_words, 1) * 1000 FOR e IN c]) AS rate FROM prof), m AS (SELECT emotion, avg(rate) AS m FROM r GROUP BY emotion), d AS (SELECT doc_id, emotion, round(rate - m, 6) AS delta FROM r JOIN m USING (emotion)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(delta) DESC, emotion) AS rank, emotion, delta FROM d QUALIFY rank <= 3",
    "ot_group_shift_terms": f"WITH w AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, unnest({WORDS}) AS term FROM documents), g AS (SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS words FROM w GROUP BY lang ORDER BY docs DESC, lang LIMIT 2), s AS (SELECT lang, term, count(*) AS n, count(*) / any_value(words) AS share FROM w JOIN g USING (lang) GROUP BY lang, term) SELECT lang, term, n, round(share, 6) AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM s QUALIFY rank <= 20",
    "ot_token_vad_cost": f"WITH {LEX}, {_CONF}, p AS (SELECT x.term, round(least(sqrt((x.v - y.v) * (x.v - y.v) + (x.a - y.a) * (x.a - y.a) + (x.d - y.d) * (x.d - y.d)) / (2 * sqrt(3)), 1.0) * x.conf * y.conf + 1 - x.conf * y.conf, 6) AS cost FROM vad x, vad y WHERE x.term < y.term) SELECT term, count(*) AS n, min(cost) AS least, sum(round(cost * 1000000)::BIGINT)::BIGINT AS millionths FROM p GROUP BY term",
    "emb_cosine_knn": f"WITH {KNN} SELECT i, j, rank, round(distance, 6) AS distance FROM nn WHERE rank <= 5",
    "emb_centroids": f"WITH {CENTROIDS} SELECT label, dim, round(value, 6) AS value FROM cen",
    "emb_max_cosine_conf": f"WITH {CENTROIDS} SELECT vec_id, round(least(greatest((max(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) + 1) / 2, 0), 1), 6) AS conf FROM embeddings, ref GROUP BY vec_id",
    "emb_top1_label_coherence": f"WITH {KNN} SELECT il AS label, count(*) AS n, round(avg((il = jl)::INT), 6) AS same_rate FROM nn WHERE rank = 1 GROUP BY il",
    "emb_intra_inter_separation": f"WITH {CENTROIDS}, d AS (SELECT label = ref AS same, (1 - list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(c, c))) / 2 AS distance FROM embeddings, ref) SELECT count(*) FILTER (same) AS within, count(*) FILTER (NOT same) AS between, round((avg(distance) FILTER (NOT same) - avg(distance) FILTER (same)) / sqrt((var_pop(distance) FILTER (same) + var_pop(distance) FILTER (NOT same)) / 2), 6) AS effect FROM d",
    "rollup_year_type": "WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, event_type AS k, value FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL) SELECT month, CASE WHEN grouping(k) = 1 THEN 'ALL' ELSE k END AS kind, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM e GROUP BY GROUPING SETS ((month, k), (month))",
    "rollup_topn_per_emotion": f"WITH {PROF}{_RATES} SELECT emotion, row_number() OVER (PARTITION BY emotion ORDER BY rate DESC, doc_id) AS rank, doc_id, rate FROM rates QUALIFY rank <= 5",
    "rollup_tertiles": f"WITH {ARR}, r AS (SELECT doc_id, row_number() OVER (ORDER BY len(ts), doc_id) AS row, count(*) OVER () AS n FROM arr) SELECT doc_id, CASE WHEN row <= n // 3 THEN 'low' WHEN row <= 2 * n // 3 THEN 'mid' ELSE 'high' END AS tertile FROM r",
    "rollup_scorecard": f"WITH {LEX}, s AS (SELECT arr.doc_id, any_value(len(ts)) AS n_raw, count(terms.term) AS n_selected FROM arr LEFT JOIN tok ON tok.doc_id = arr.doc_id LEFT JOIN terms ON terms.term = tok.term GROUP BY arr.doc_id), c AS (SELECT sum(n_selected) / sum(n_raw) AS coverage, avg((n_selected = 0)::INT) AS zero_share, avg((n_selected >= 3)::INT) AS explained FROM s), {KNN}, t1 AS (SELECT avg((il = jl)::INT) AS top1 FROM nn WHERE rank = 1), {CENTROIDS}, sd AS (SELECT label = ref AS same, (1 - list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(c, c))) / 2 AS distance FROM embeddings, ref), se AS (SELECT round((avg(distance) FILTER (NOT same) - avg(distance) FILTER (same)) / sqrt((var_pop(distance) FILTER (same) + var_pop(distance) FILTER (NOT same)) / 2), 6) AS effect FROM sd), t AS (SELECT *, greatest(0, 35 * least(1, greatest(0, coverage / 0.1)) + 20 * least(1, greatest(0, top1)) + 25 * least(1, greatest(0, effect / 2)) + 20 * least(1, greatest(0, explained)) - 20 * least(1, greatest(0, zero_share / 0.5))) AS score FROM c, t1, se) SELECT round(coverage, 6) AS coverage, round(zero_share, 6) AS zero_share, round(top1, 6) AS top1, round(effect, 6) AS effect, round(explained, 6) AS explained, round(score, 6) AS score, CASE WHEN t.score >= 75 THEN 'strong' WHEN t.score >= 50 THEN 'usable' ELSE 'weak' END AS verdict, concat_ws('; ', CASE WHEN t.coverage < 0.9 THEN 'coverage below 0.9' END, CASE WHEN t.zero_share > 0.02 THEN 'zero_share above 0.02' END) AS reasons FROM t",
    "eval_confusion_f1": "WITH r AS (SELECT quality AS g, (n_chars > 1000)::INT AS p FROM labels JOIN documents USING (doc_id)), k AS (SELECT DISTINCT unnest([g, p]) AS label FROM r), c AS (SELECT label, count(*) FILTER (g = label) AS support, count(*) FILTER (p = label) AS claimed, count(*) FILTER (g = label AND p = label) AS tp FROM r, k GROUP BY label) SELECT label::BIGINT AS label, support, round(CASE WHEN claimed > 0 THEN tp / claimed ELSE 0.0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 6) AS recall, round(CASE WHEN claimed + support > 0 THEN 2 * tp / (claimed + support) ELSE 0.0 END, 6) AS f1 FROM c",
    "eval_multilabel_f1": "WITH r AS (SELECT * FROM labels JOIN documents USING (doc_id)), e AS (SELECT 'quality' AS label, quality AS g, (n_chars > 1000)::INT AS p FROM r UNION ALL SELECT 'toxic', toxic, contains(text, 'idiot')::INT FROM r WHERE n_chars > 500), c AS (SELECT label, sum(g * p)::BIGINT AS tp, sum((1 - g) * p)::BIGINT AS fp, sum(g * (1 - p))::BIGINT AS fn FROM e GROUP BY label), f AS (SELECT *, CASE WHEN tp + (fp + fn) / 2 > 0 THEN tp / (tp + (fp + fn) / 2) ELSE 0.0 END AS f1 FROM c) SELECT label, tp, fp, fn, round(f1, 6) AS f1 FROM f UNION ALL SELECT 'MICRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(sum(tp) / (sum(tp) + (sum(fp) + sum(fn)) / 2), 6) FROM f UNION ALL SELECT 'MACRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(f.f1), 6) FROM f",
    "eval_auc_by_emotion": f"WITH {PROF}{_RATES}, r AS (SELECT emotion, rate, toxic FROM rates JOIN labels USING (doc_id)), k AS (SELECT *, rank() OVER (PARTITION BY emotion ORDER BY rate) + (count(*) OVER (PARTITION BY emotion, rate) - 1) / 2 AS rk FROM r), s AS (SELECT emotion, count(*) AS n, sum(rk) FILTER (toxic = 1) AS sr, count(*) FILTER (toxic = 1) AS p FROM k GROUP BY emotion) SELECT emotion, n, round((sr - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM s",
    "adj_latest_upsert": "WITH l AS (SELECT user_id, round(value, 6) AS judged, CASE WHEN event_id % 2 = 0 THEN 'AGREE' ELSE 'DISAGREE' END AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 3 = 0), a AS (SELECT user_id, round(max(value), 6) AS automatic FROM events GROUP BY user_id), j AS (SELECT a.user_id, automatic, judged, CASE WHEN decision IS NULL THEN 'missing' WHEN decision = 'DISAGREE' THEN 'disagree' WHEN abs(automatic - judged) <= 1e-3 THEN 'agree' ELSE 'mismatch' END AS status FROM a LEFT JOIN (SELECT * FROM l WHERE r = 1) l USING (user_id)) SELECT user_id, automatic, status, CASE WHEN status = 'disagree' THEN judged ELSE automatic END AS final FROM j",
    "split_by_group_hash": "WITH g AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id::VARCHAR || ':13'), conv_id) AS row, count(*) OVER () AS n FROM g) SELECT conv_id, CASE WHEN row <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) THEN 'dev' ELSE 'train' END AS split FROM r",
    "sample_stratified_hash": "WITH d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, md5(doc_id::VARCHAR || ':13') AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k FROM d), rest AS (SELECT doc_id, source FROM r WHERE k > 3 ORDER BY h, doc_id LIMIT 5) SELECT doc_id, source, 'stratum' AS part FROM r WHERE k <= 3 UNION ALL SELECT doc_id, source, 'rest' FROM rest",
    "contain_exact_ordered": "WITH i AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents) SELECT item_id AS item, doc_id AS doc FROM i, d WHERE i.t <> '' AND contains(' ' || d.t || ' ', ' ' || i.t || ' ')",
    "teacher_noisy_or": f"WITH {PROF}, n AS (SELECT doc_id, {_NORM.format(x='c')} AS p FROM prof) SELECT doc_id, round(1 - (1 - p[1]) * (1 - p[2]) * (1 - p[3]) * (1 - p[4]), 6) AS p FROM n",
    "meta_parse": f"WITH p AS ({_NAMES} UNION ALL SELECT 'texts/ICJ_' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '_Case' || doc_id || '_19' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-04-09_' || CASE WHEN doc_id % 2 = 0 THEN 'JUD' ELSE 'ORD' END || '_01.txt' FROM documents), q AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, string_split(path, '/') AS f FROM p), s AS (SELECT *, string_split(stem, '_') AS parts, list_position(f, 'crystal_ball_data') AS root FROM q), t AS (SELECT *, len(parts) >= 2 AND parts[1] = 'ICJ' AS court, list_position([regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}') FOR x IN parts], true) AS dated FROM s), o AS (SELECT *, NOT court AND root IS NOT NULL AND root > 0 AS other FROM t) SELECT path, stem, CASE WHEN court THEN 'ICJ' WHEN other THEN 'crystal_ball' END AS source, CASE WHEN court THEN parts[2] END AS case_id, CASE WHEN court AND dated > 0 THEN parts[dated] END AS date, CASE WHEN court AND dated > 0 THEN parts[dated + 1] END AS doc_type, CASE WHEN other THEN f[root + 1] END AS split, CASE WHEN other AND f[root + 2] LIKE 'Article%' THEN f[root + 2] END AS article, CASE WHEN other THEN coalesce(CASE WHEN f[root + 3] IN ('violation', 'non-violation', 'both') THEN f[root + 3] END, CASE WHEN f[root + 1] = 'test_violations' THEN 'violation' END) END AS outcome FROM o",
    "text_boilerplate_strip": (
        "WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)), "
        f"n AS (SELECT *, strip_accents(lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))) AS norm, trim(line) = '' AS blank, {_CAPS} AS caps, trim(line) <> '' AND ({_NUMBER} OR {_LABEL}) AS page FROM l), "
        f"o AS (SELECT *, starts_with(norm, 'table of contents') AND NOT page AS opens, max(CASE WHEN NOT blank THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filled, {_TOC.format(x='trim(line)')} AS toc FROM n), "
        "s AS (SELECT *, max(CASE WHEN opens THEN pos END) OVER w AS opened, max(CASE WHEN (blank AND pos - coalesce(filled, -1) >= 2) OR (NOT blank AND NOT page AND NOT opens AND NOT toc) THEN pos END) OVER w AS ended, count(*) FILTER (length(norm) >= 6) OVER (PARTITION BY doc_id, norm) AS alike FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)), "
        f"k AS (SELECT doc_id, pos, line FROM s WHERE blank OR (NOT page AND NOT (opened IS NOT NULL AND coalesce(ended, -1) < opened) AND NOT (caps AND (pos < 80 OR alike >= 3 OR regexp_matches(norm, '{HEADERS}') OR regexp_matches(norm, '{CASE_MARK}') OR regexp_matches(trim(line), '^\\d{{1,4}}\\s+[A-Z]'))))) "
        "SELECT documents.doc_id, coalesce(any_value(m.n), 0) AS n_left FROM documents LEFT JOIN (SELECT doc_id, length(string_agg(line, chr(10) ORDER BY pos)) AS n FROM k GROUP BY doc_id) m USING (doc_id) GROUP BY documents.doc_id"
    ),
    "text_excerpts": "WITH b AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(replace(replace(replace(replace(translate(coalesce(text, ''), '" + _FROM + "', '" + _TO + "'), '“', '\"'), '”', '\"'), '„', '\"'), '…', '...'), '\\s+', ' ', 'g')) AS plain FROM documents), a AS (SELECT *, CASE WHEN regexp_matches(t, '\\bthe\\b') THEN greatest(length(regexp_split_to_array(t, '\\bthe\\b')[1]) - 20, 0) ELSE 0 END AS p FROM b) SELECT doc_id, CASE WHEN p > 0 THEN '…' ELSE '' END || trim(substr(t, p + 1, 60)) || CASE WHEN length(t) > p + 60 THEN '…' ELSE '' END AS around, trim(substr(t, 1, 40)) || CASE WHEN length(t) > 40 THEN '…' ELSE '' END AS head, length(plain) AS n_plain FROM a",
    "label_keys": "SELECT doc_id, regexp_replace(lower(trim(' ' || upper(lang) || '-' || source || ' ')), '[\\s-]+', '_', 'g') AS label, (doc_id % 7 = 0 OR lang IS NULL)::INT AS unlabelled, (contains(lower(source), 'rc1') OR contains(lower(source), '7'))::INT AS hit, CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'unknown' END AS key FROM documents",
    "teacher_classes": f"WITH {PROF}, r AS (SELECT doc_id, c[1:3] AS q FROM prof), p AS (SELECT doc_id, {_NORM.format(x='q')} AS p FROM r) SELECT doc_id, list_position(p, list_max(p)) - 1 AS label, list_position(p, list_max(p)) - 2 AS sentiment, round(-p[1] + p[3], 6) AS score FROM p",
    "sample_balanced_by_class": "WITH d AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, md5(doc_id::VARCHAR || ':13') AS h FROM documents), k AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM d)), r AS (SELECT doc_id, d.lang, h, row_number() OVER (PARTITION BY d.lang ORDER BY h, doc_id) AS rank, 50 // n + (i <= 50 % n)::INT AS share FROM d JOIN k USING (lang)), f AS (SELECT doc_id, lang FROM r WHERE rank <= share) SELECT * FROM f UNION ALL (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS place FROM r WHERE rank > share AND rank <= 50) WHERE place <= 50 - (SELECT count(*) FROM f))",
    "text_line_chunks": "WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), f AS (SELECT doc_id, ls, 1 AS i, length(ls[1])::BIGINT AS held, []::BIGINT[] AS done FROM l UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN held + 1 + length(ls[i + 1]) > 400 THEN length(ls[i + 1]) ELSE held + 1 + length(ls[i + 1]) END, CASE WHEN held + 1 + length(ls[i + 1]) > 400 THEN list_append(done, held) ELSE done END FROM f WHERE i < len(ls)) SELECT doc_id, len(done) + 1 AS chunks, greatest(held, coalesce(list_max(done), 0)) AS longest FROM f WHERE i = len(ls)",
    "stream_windowed_signal": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL",
}
