"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

from lexmill.operators.contingency import CHI2_THRESHOLD
from lexmill.operators.graph import INDICES
from lexmill.plans import inputs


def _values(rows: tuple[tuple, ...] | list[tuple]) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: A walk ends at a word without a synonym, or at the first that it meets again.
_CLOSED = """
    WITH RECURSIVE pairs(variant, canonical) AS ({synonyms}),
    walk AS (
        SELECT variant, canonical AS node, [variant] AS seen FROM pairs
        UNION ALL
        SELECT w.variant, p.canonical, list_append(w.seen, w.node) FROM walk w JOIN pairs p ON p.variant = w.node WHERE NOT list_contains(w.seen, w.node)),
    synonyms AS (SELECT variant, max_by(node, len(seen)) AS canonical FROM walk GROUP BY variant)""".replace(
    "{synonyms}", _values(list(inputs.SYNONYMS.items()))
)

_LEXED = r"""
    lexicon(form, lemma, pos) AS ({lexicon}),
    keyed AS (
        SELECT *, CASE WHEN ends_with(pos, '_sup') THEN 2
            WHEN regexp_matches(CASE WHEN pos = 'conj' THEN 'con' ELSE pos END, '^(art|aux|con|pre|pro|ono)') THEN 2 ELSE 1 END AS key
        FROM lexicon),
    words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS token FROM documents),
    known AS (
        SELECT token, coalesce(a.canonical, b.canonical, keyed.lemma, token) AS lemma, coalesce(pos, 'nom') AS pos,
            form IS NOT NULL AS known, coalesce(key, 1) AS key
        FROM words LEFT JOIN keyed ON form = token
        LEFT JOIN synonyms a ON a.variant = coalesce(keyed.lemma, token) LEFT JOIN synonyms b ON b.variant = token),
    lexed AS (
        SELECT token, lemma, pos, known,
            CASE WHEN length(token) < 2 THEN false WHEN token IN ({stop}) OR lemma IN ({stop}) THEN false
                WHEN starts_with(pos, 'adv') THEN false ELSE key = 1 END AS active
        FROM known)""".replace("{lexicon}", _values(inputs.LEXICON)).replace("{stop}", _list(inputs.PREP.stopwords))

_SEGMENTS = r"""
    pieces AS (
        SELECT doc_id, lang, source, list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n\r]+[.!?;]?'),
            lambda s: regexp_replace(regexp_replace(s, '^[\s\x{0b}\x{a0}]+', ''), '[\s\x{0b}\x{a0}]+$', '')), lambda s: s <> '') AS ss
        FROM documents),
    tokenised AS (
        SELECT *, list_transform(ss, lambda s: regexp_extract_all(lower(s), '[\p{L}\p{Nl}\p{No}]+')) AS tt FROM pieces WHERE len(ss) > 0),
    placed AS (
        SELECT *, list_reduce(list_transform(tt, lambda t: [len(t)]),
            lambda acc, x: CASE WHEN acc[1] + x[1] >= 40 THEN list_concat(list_concat([0, acc[2] + 1], acc[3:]), [acc[2]])
                ELSE list_concat(list_concat([acc[1] + x[1], acc[2]], acc[3:]), [acc[2]]) END, [0::BIGINT, 0::BIGINT])[3:] AS seg
        FROM tokenised),
    sentences AS (
        SELECT doc_id, lang, source, unnest(ss) AS s, unnest(tt) AS t, unnest(seg) AS uce_index, generate_subscripts(ss, 1) AS i FROM placed),
    segments AS (
        SELECT doc_id, lang, source, uce_index, printf('%s__uce%04d', doc_id::VARCHAR, uce_index) AS uce_id,
            string_agg(s, ' ' ORDER BY i) AS text, flatten(list(t ORDER BY i)) AS tokens
        FROM sentences GROUP BY ALL),
    surface AS (SELECT doc_id, lang, source, uce_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM segments),
    active AS (
        SELECT doc_id, lang, source, uce_id, surface.pos AS pos, lemma AS form FROM surface JOIN lexed USING (token) WHERE active),
    stats AS (SELECT form, count(*) AS freq, count(DISTINCT uce_id) AS n_uce FROM active GROUP BY form),
    dtm AS (SELECT DISTINCT uce_id, form, lang, source, doc_id FROM active JOIN stats USING (form) WHERE freq >= 3)"""

_TERMS = f"""
    units AS (SELECT lang AS class, count(DISTINCT uce_id) AS n_class FROM dtm GROUP BY lang),
    whole AS (SELECT sum(n_class)::DOUBLE AS total FROM units),
    cells AS (SELECT form, lang AS class, count(*) AS n FROM dtm GROUP BY form, lang),
    crossed AS (
        SELECT form, class, n, sum(n) OVER (PARTITION BY form)::DOUBLE AS f, n_class::DOUBLE AS c, total
        FROM cells JOIN units USING (class) CROSS JOIN whole),
    scored AS (
        SELECT *, CASE WHEN c * (total - c) * f * (total - f) > 0 THEN total * (n * total - c * f) ^ 2 / ((c * (total - c)) * (f * (total - f))) ELSE 0 END AS chi2
        FROM crossed),
    terms AS (
        SELECT class, form, round(chi2, 4) AS chi2, CASE WHEN n >= c * f / total THEN '+' ELSE '-' END AS sign,
            n AS n_in_class, f::BIGINT AS n_total,
            round(least(c * f / total, c * (total - f) / total, (total - c) * f / total, (total - c) * (total - f) / total), 2) AS min_expected
        FROM scored WHERE chi2 >= {CHI2_THRESHOLD})"""

_TOP60 = """
    top60 AS (SELECT form, count(*) AS freq FROM dtm GROUP BY form ORDER BY freq DESC, form LIMIT 60),
    met AS (
        SELECT x.form AS form_i, y.form AS form_j, count(*) AS a
        FROM dtm x JOIN dtm y ON x.uce_id = y.uce_id AND x.form < y.form
        WHERE x.form IN (SELECT form FROM top60) AND y.form IN (SELECT form FROM top60) GROUP BY ALL),
    size AS (SELECT count(DISTINCT uce_id)::DOUBLE AS n FROM dtm),
    cooc AS (
        SELECT form_i, form_j, a, i.freq AS f_i, j.freq AS f_j, n
        FROM met JOIN top60 i ON i.form = form_i JOIN top60 j ON j.form = form_j CROSS JOIN size)"""

_GROUPS = """
    grouped AS (SELECT form, source AS g, count(*) AS n FROM dtm WHERE lower(trim(source)) NOT IN ('', 'nan', 'none', 'null') GROUP BY ALL),
    sizes AS (SELECT g, sum(n)::DOUBLE AS size FROM grouped GROUP BY g),
    shared AS (
        SELECT x.g AS a, y.g AS b, sum(least(x.n * least(p.size, q.size) / p.size, y.n * least(p.size, q.size) / q.size)) AS common
        FROM grouped x JOIN grouped y ON x.form = y.form AND x.g < y.g JOIN sizes p ON p.g = x.g JOIN sizes q ON q.g = y.g GROUP BY ALL),
    labbe AS (
        SELECT p.g AS group_a, q.g AS group_b, round(1 - coalesce(common, 0) / least(p.size, q.size), 6) AS distance
        FROM sizes p JOIN sizes q ON p.g < q.g LEFT JOIN shared ON a = p.g AND b = q.g)"""

_CURVE = """
    steps AS (SELECT g, row_number() OVER (ORDER BY g) AS k FROM (SELECT DISTINCT source AS g FROM segments WHERE lower(trim(source)) NOT IN ('', 'nan', 'none', '?'))),
    counted AS (SELECT form, k, count(*) AS n FROM dtm JOIN steps ON g = source GROUP BY ALL),
    upto AS (SELECT form, k, sum(n) OVER (PARTITION BY form ORDER BY k) AS upto FROM counted),
    entered AS (SELECT form, min(k) AS k FROM upto WHERE upto >= 3 GROUP BY form),
    curve AS (
        SELECT k, sum(new) OVER (ORDER BY k)::BIGINT AS vocab, new, round(new / nullif(sum(new) OVER (ORDER BY k), 0), 4) AS new_ratio
        FROM (SELECT steps.k, count(entered.form) AS new FROM steps LEFT JOIN entered ON entered.k = steps.k GROUP BY steps.k))"""

_PARTS = """
    named AS (
        SELECT form, 'lang' AS variable, lang AS part, uce_id FROM dtm WHERE trim(lang) <> ''
        UNION ALL SELECT form, 'source', source, uce_id FROM dtm WHERE trim(source) <> ''),
    filled AS (SELECT variable, form, part, count(*) AS k FROM named GROUP BY ALL),
    valued AS (SELECT DISTINCT variable, part FROM filled WHERE variable IN (SELECT variable FROM filled GROUP BY variable HAVING count(DISTINCT part) > 1)),
    parts AS (
        SELECT variable, form, part, coalesce(k, 0) AS k
        FROM (SELECT DISTINCT variable, form FROM filled) JOIN valued USING (variable) LEFT JOIN filled USING (variable, form, part)),
    margins AS (
        SELECT *, sum(k) OVER (PARTITION BY variable, form)::BIGINT AS r, sum(k) OVER (PARTITION BY variable, part)::BIGINT AS c,
            sum(k) OVER (PARTITION BY variable)::BIGINT AS t FROM parts),
    tails AS (
        SELECT *, -log10(greatest(1e-300, least(1.0, list_sum(list_transform(CASE WHEN k >= r * c / t THEN range(k, least(r, c) + 1) ELSE range(greatest(0, c - t + r), k + 1) END,
            lambda i: exp(lgamma(r + 1.0) - lgamma(i + 1.0) - lgamma(r - i + 1.0) + lgamma(t - r + 1.0) - lgamma(c - i + 1.0) - lgamma(t - r - c + i + 1.0)
                - lgamma(t + 1.0) + lgamma(c + 1.0) + lgamma(t - c + 1.0))))))) AS raw
        FROM (SELECT DISTINCT r, c, t, k FROM margins))"""

_CUT = """
    ordered AS (SELECT uce_id, row_number() OVER (ORDER BY len(tokens), uce_id) AS pos FROM segments),
    met_at AS (
        SELECT pos, row_number() OVER (PARTITION BY form ORDER BY pos) AS m, count(*) OVER (PARTITION BY form) AS col FROM dtm JOIN ordered USING (uce_id)),
    moves AS (SELECT pos, sum((2 * m - 1) / col) AS dq, count(*) AS ds FROM met_at GROUP BY pos),
    running AS (
        SELECT pos, sum(coalesce(dq, 0)) OVER (ORDER BY pos) AS q, (sum(coalesce(ds, 0)) OVER (ORDER BY pos))::DOUBLE AS s,
            (sum(coalesce(ds, 0)) OVER ())::DOUBLE AS n, max(pos) OVER () AS last
        FROM ordered LEFT JOIN moves USING (pos))"""

_SPEECH = r"""
    sents AS (
        SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS sent FROM pieces),
    spoken AS (
        SELECT doc_id, sent, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
        FROM (SELECT doc_id, sent, regexp_extract_all(lower(s), '[\p{L}\p{Nl}\p{No}]+') AS ws FROM sents)),
    negated AS (
        SELECT *, token IN ({negations}) AS neg,
            max(CASE WHEN token IN ({negations}) THEN pos END) OVER (PARTITION BY doc_id, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
        FROM spoken),
    valued_words(lemma, polarity) AS ({polarity}),
    turned AS (
        SELECT doc_id, CASE WHEN coalesce(negated.pos - last <= 3, false) THEN -polarity ELSE polarity END AS v
        FROM negated JOIN lexed USING (token) JOIN valued_words USING (lemma) WHERE NOT neg),
    summed AS (SELECT doc_id, count(*) FILTER (v > 0) AS p, count(*) FILTER (v < 0) AS m FROM turned GROUP BY doc_id),
    sentiment AS (
        SELECT doc_id, lang, coalesce(p, 0) - coalesce(m, 0) AS score, coalesce(p, 0) AS n_positive, coalesce(m, 0) AS n_negative
        FROM documents LEFT JOIN summed USING (doc_id)),
    labelled AS (SELECT *, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS label FROM sentiment)""".replace(
    "{negations}", _list(inputs.NEGATIONS)
).replace("{polarity}", _values(inputs.POLARITY))

_EMOTIONS = r"""
    felt(form, emotion) AS ({emotions}),
    uttered AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS form FROM documents),
    emotions AS (
        SELECT d.doc_id, d.lang, {counts}
        FROM documents d LEFT JOIN (SELECT doc_id, emotion FROM uttered JOIN felt USING (form)) e ON e.doc_id = d.doc_id GROUP BY d.doc_id, d.lang)""".replace(
    "{emotions}", _values(inputs.EMOTIONS)
).replace("{counts}", ", ".join(f"count(*) FILTER (emotion = '{c}') AS {c}" for c in inputs.CATEGORIES))

_HITS = r"""
    numbered AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS ws FROM documents),
    occurring AS (SELECT rid, doc_id, ws, unnest(ws) AS token, generate_subscripts(ws, 1) AS spot FROM numbered),
    hits AS (SELECT * FROM occurring JOIN lexed USING (token) WHERE lemma = 'rewh'),
    contexts AS (
        SELECT doc_id, array_to_string(ws[greatest(spot - 6, 1) : spot - 1], ' ') AS "left", token AS keyword,
            array_to_string(ws[spot + 1 : spot + 6], ' ') AS "right", spot - 1 AS position FROM {hits})"""

_TREE = """
    branches AS (SELECT {branch} AS b FROM hits),
    paths AS (SELECT array_to_string(b[:k], ' ') AS path, k AS depth FROM branches, range(1, 3) t(k) WHERE k <= len(b))"""

_WEIGHTS = {
    "cooccurrence": "a::DOUBLE",
    "jaccard": "a / (f_i + f_j - a)::DOUBLE",
    "dice": "2.0 * a / (f_i + f_j)",
    "cosine": "a / sqrt(f_i::DOUBLE * f_j)",
    "phi": "coalesce((a * (n - f_i - f_j + a) - (f_i - a)::DOUBLE * (f_j - a)) / nullif(sqrt(f_i * (n - f_i) * f_j * (n - f_j)), 0), 0)",
}

_DIAGNOSTICS = """
    one AS (SELECT count(*) AS n_uci, count(*) FILTER (k <= 1) AS n_single_uce FROM (SELECT doc_id, count(*) AS k FROM segments GROUP BY doc_id)),
    lengths AS (
        SELECT count(*) AS n_uce, min(len(tokens)) AS tokens_min, median(len(tokens))::DOUBLE AS tokens_median, round(avg(len(tokens)), 1) AS tokens_mean,
            max(len(tokens)) AS tokens_max, sum(len(tokens))::BIGINT AS tokens_total FROM segments),
    shapes AS (
        SELECT sum(freq)::BIGINT AS active_total, count(*) AS vocabulary, count(*) FILTER (freq = 1) AS hapax, count(*) FILTER (freq >= 3) AS retained_forms FROM stats),
    figures AS (
        SELECT *, round(active_total / tokens_total, 3) AS active_ratio, round(100 * hapax / vocabulary, 1) AS hapax_pct, round(100 * n_filled / n_uce, 1) AS filled_pct
        FROM one, lengths, shapes, (SELECT count(DISTINCT uce_id) AS n_filled FROM dtm))"""


def _base(body: str, *more: str) -> str:
    return ",".join([_CLOSED, _LEXED, _SEGMENTS, *more]) + body


def _ngrams(n: int, tail: str = "") -> str:
    return _base(
        f"""
    SELECT array_to_string(fs[i : i + {n - 1}], ' ') AS ngram, count(*) AS n
    FROM (SELECT list(form ORDER BY pos) AS fs FROM active GROUP BY uce_id), range(1, 100000) t(i) WHERE i <= len(fs) - {n - 1} GROUP BY ngram{tail}"""
    )


def _expressions(*passes: dict[str, str]) -> str:
    text = r"' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+'), '  ') || ' '"
    for phrase, merged in [x for table in passes for x in sorted(table.items(), key=lambda x: -len(x[0].split()))]:
        text = f"replace({text}, ' {'  '.join(phrase.split())} ', ' {merged} ')"
    return f"""
    SELECT doc_id, CASE WHEN merged = '' THEN 0 ELSE len(string_split(merged, ' ')) END AS n_tokens, merged AS tokens
    FROM (SELECT doc_id, replace(trim({text}), '  ', ' ') AS merged FROM documents)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query."""
    curve = ", ".join(f"round(avg({c}), 2) AS {c}" for c in inputs.CATEGORIES)
    seeds = _list(tuple(sorted(inputs.SEEDS["second"])))
    means = " UNION ALL ".join(f"SELECT '{c}' AS emotion, round(avg({c}), 4) AS mean FROM emotions" for c in inputs.CATEGORIES)
    unit = lambda c, up: f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)" if up else f"1 - coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"
    hits = _HITS.replace("{hits}", "hits")
    found = {
        "token_counts": r"""
            SELECT token, count(*) AS n
            FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS token FROM documents)
            GROUP BY token""",
        "sentence_counts": _base(" SELECT doc_id, len(ss) AS n_sentences FROM pieces"),
        "clean_artifacts": r"""
            SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
                '[(\[][^)\]\n]{0,60}[)\]]', ' ', 'g'), '(?i)\b(?:inaud[ií]vel|incompreens[ií]vel|ininteleg[ií]vel|ininteligível)\b', ' ', 'g'),
                '(?i)\b(?:participante|moderador|palestrante|entrevistadora?|mediadora?)\s*\d*\b', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '^[\s\x{0b}\x{a0}]+', ''), '[\s\x{0b}\x{a0}]+$', '') AS text
            FROM documents""",
        "strip_markdown": r"""
            SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
                '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
                '(?m)^\s{0,3}(?:#{1,6}|>|[-*+]|\d+\.)\s+', '', 'g'), '[*_]{1,3}([^*_]+)[*_]{1,3}', '\1', 'g') AS text
            FROM documents""",
        "strip_accents": "SELECT doc_id, strip_accents(text) AS text FROM documents",
        "normalise_blanks": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, regexp_replace(source, '[^\p{L}\p{N}_]+', '_', 'g') AS slug FROM documents",
        "speaker_filter": r"""
            WITH scripts AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS script FROM conversations GROUP BY conv_id),
            lines AS (
                SELECT conv_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
                FROM (SELECT conv_id, string_split_regex(regexp_replace(script, '(?:\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS ls FROM scripts)),
            marked AS (SELECT *, regexp_extract(line, '^\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.\d ]{0,38}?)\s*:\s', 1) AS label FROM lines),
            spoken AS (
                SELECT conv_id, i, label, last_value(nullif(label, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS speaker,
                    CASE WHEN label <> '' THEN regexp_replace(line, '^\s*[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.\d ]{0,38}?\s*:\s', '') ELSE line END AS body
                FROM marked),
            judged AS (SELECT *, coalesce(regexp_matches(speaker, '(?i)^\s*(?:system|user)'), false) AS gone FROM spoken)
            SELECT conv_id, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone AND label <> '') AS n_dropped
            FROM judged GROUP BY conv_id""",
        "synonym_closure": _CLOSED + " SELECT variant, canonical FROM synonyms",
        "lemma_map": _base(" SELECT token, lemma, pos, known, active FROM lexed"),
        "expressions_merge": _expressions(inputs.EXPRESSIONS),
        "expressions_two_passes": _expressions(inputs.EXPRESSIONS, inputs.LEXICON_EXPRESSIONS),
        "segments": _base(" SELECT uce_id, doc_id, uce_index, text, len(tokens) AS n_tokens FROM segments"),
        "active_forms": _base(" SELECT uce_id, pos, form FROM active"),
        "inactive_tokens": _base(" SELECT token FROM lexed WHERE NOT active AND token IN (SELECT token FROM surface)"),
        "forms_freq": _base(" SELECT form, freq, n_uce FROM stats"),
        "top_forms": _base(" SELECT form, freq, n_uce FROM stats ORDER BY freq DESC, form LIMIT 15"),
        "dtm_pairs": _base(" SELECT uce_id, form FROM dtm"),
        "dtm_row_sizes": _base(" SELECT uce_id, count(*) AS n_forms FROM dtm GROUP BY uce_id"),
        "count_matrix": _base(" SELECT doc_id, form, count(*) AS n FROM active JOIN stats USING (form) WHERE freq >= 3 GROUP BY doc_id, form"),
        "diagnostics": _base(" SELECT * FROM figures", _DIAGNOSTICS),
        "advice": _base(
            """ SELECT unnest(list_filter([
                CASE WHEN n_uce < 30 THEN 'few segments: classes will be unstable' END,
                CASE WHEN tokens_median < 8 THEN 'segments are very short: raise the segment size' END,
                CASE WHEN filled_pct < 80 THEN 'many segments lose all forms: lower the frequency threshold' END,
                CASE WHEN hapax_pct > 60 THEN 'most forms occur once: check lemmas and spelling' END,
                CASE WHEN retained_forms < 20 THEN 'few forms are retained: lower the frequency threshold' END,
                CASE WHEN n_single_uce > 0.5 * n_uci THEN 'most documents are one segment: lower the segment size' END],
                lambda x: x IS NOT NULL)) AS advice FROM figures""",
            _DIAGNOSTICS,
        ),
        "length_histogram": _base(" SELECT len(tokens) // 5 * 5 AS bin, count(*) AS count FROM segments GROUP BY bin"),
        "signed_chi2_terms": _base(" SELECT * FROM terms", _TERMS),
        "typical_segments": _base(
            """ SELECT class, rank, uce_id, score FROM (
                SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, uce_id DESC) AS rank FROM (
                    SELECT lang AS class, uce_id, round(sum(chi2), 4) AS score FROM dtm JOIN terms ON terms.class = lang AND terms.form = dtm.form WHERE sign = '+' GROUP BY ALL))
                WHERE rank <= 5""",
            _TERMS,
        ),
        "partition_warnings": _base(
            """, blocks AS (SELECT lang AS class, count(*) AS n FROM segments GROUP BY lang)
            SELECT 'fewer classes than asked' AS warning, count(*) AS value FROM blocks HAVING count(*) < 6
            UNION ALL SELECT 'small class ' || class, n FROM blocks WHERE n < 10
            UNION ALL SELECT 'terms with an expected count below 5', count(*) FROM terms WHERE min_expected < 5""",
            _TERMS,
        ),
        "heatmap_props": _base(
            """, spread AS (SELECT form FROM dtm GROUP BY form ORDER BY count(*) DESC, form LIMIT 20)
            SELECT spread.form, units.class, round(coalesce(n, 0) / n_class, 4) AS share
            FROM spread CROSS JOIN units LEFT JOIN cells ON cells.form = spread.form AND cells.class = units.class""",
            _TERMS,
        ),
        "part_table": _base(" SELECT variable, form, part, k FROM parts", _PARTS),
        "specificities": _base(
            """ SELECT variable, form, part, round(raw, 3) AS score, CASE WHEN k >= r * c / t THEN '+' ELSE '-' END AS sign, k AS observed, round(r * c / t, 3) AS expected
            FROM margins JOIN tails USING (r, c, t, k) WHERE raw >= 2""",
            _PARTS,
        ),
        "adjusted_rand": _base(
            """, joint AS (SELECT lang, source, count(*)::DOUBLE AS n FROM segments GROUP BY ALL),
            sums AS (
                SELECT (SELECT sum(n * (n - 1) / 2) FROM joint) AS s, (SELECT sum(n) FROM joint) AS n,
                    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM joint GROUP BY lang)) AS sx,
                    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM joint GROUP BY source)) AS sy)
            SELECT round((s - sx * sy / (n * (n - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (n * (n - 1) / 2)), 6) AS ari FROM sums"""
        ),
        "inertia_cut": _base(
            " SELECT pos, round(CASE WHEN s > 0 AND s < n THEN n * n / (s * (n - s)) * (q - s * s / n) ELSE 0 END, 4) AS chi2 FROM running WHERE pos < last", _CUT
        ),
        "form_class_table": _base(" SELECT form, lang AS class, count(*) AS n FROM dtm GROUP BY form, lang"),
        "afc_inertia": _base(
            """ SELECT round(n * (q - 1), 4) AS chi2, round(q - 1, 6) AS total_inertia, n FROM (
                SELECT sum(n * n / (r * c)) AS q, sum(n)::BIGINT AS n FROM (
                    SELECT n, sum(n) OVER (PARTITION BY form) AS r, sum(n) OVER (PARTITION BY class) AS c FROM cells))""",
            _TERMS,
        ),
        "phi_bug_delta": _base(
            """, grid AS (
                SELECT i.freq::DOUBLE AS fi, j.freq::DOUBLE AS fj, coalesce(met.a, 0)::DOUBLE AS a, n, (SELECT count(*)::DOUBLE FROM top60) AS v
                FROM top60 i JOIN top60 j ON i.form < j.form LEFT JOIN met ON form_i = i.form AND form_j = j.form CROSS JOIN size),
            both_phi AS (
                SELECT CASE WHEN fi * (n - fi) * fj * (n - fj) > 0 THEN (a * (n - fi - fj + a) - (fi - a) * (fj - a)) / sqrt(fi * (n - fi) * fj * (n - fj)) ELSE 0 END AS x,
                    CASE WHEN fi * (v - fi) * fj * (v - fj) > 0 THEN (a * (v - fi - fj + a) - (fi - a) * (fj - a)) / sqrt(fi * (v - fi) * fj * (v - fj)) ELSE 0 END AS y,
                    v - fi - fj + a < 0 AS negative FROM grid)
            SELECT round(max(abs(x - y)), 4) AS max_abs_diff, round(avg(abs(x - y)), 4) AS mean_abs_diff, count(*) FILTER (negative) AS n_negative_d FROM both_phi""",
            _TOP60,
        ),
        "group_table": _base(' SELECT form, g AS "group", n FROM grouped', _GROUPS),
        "labbe_distance": _base(
            """ SELECT * FROM labbe UNION ALL SELECT group_b, group_a, distance FROM labbe
            UNION ALL SELECT g, g, 0::DOUBLE FROM sizes""",
            _GROUPS,
        ),
        "labbe_extremes": _base(
            """ SELECT 'closest' AS kind, * FROM (SELECT * FROM labbe ORDER BY distance, group_a, group_b LIMIT 3)
            UNION ALL SELECT 'farthest', * FROM (SELECT * FROM labbe ORDER BY distance DESC, group_a, group_b LIMIT 3)""",
            _GROUPS,
        ),
        "ktune_combine": f"""
            WITH t(k, griffiths, cao_juan, arun, deveaud) AS ({_values(inputs.TUNING)}),
            s AS (SELECT k, round(({unit('griffiths', True)} + {unit('cao_juan', False)} + {unit('arun', False)} + {unit('deveaud', True)})::DOUBLE / 4, 6) AS support
                FROM (SELECT k, griffiths::DOUBLE AS griffiths, cao_juan::DOUBLE AS cao_juan, arun::DOUBLE AS arun, deveaud::DOUBLE AS deveaud FROM t))
            SELECT k::BIGINT AS k, support, row_number() OVER (ORDER BY support DESC, k) = 1 AS suggested FROM s""",
        "bigrams": _ngrams(2),
        "trigrams": _ngrams(3),
        "top_bigrams": _ngrams(2, " ORDER BY n DESC, ngram LIMIT 200"),
        "kwic_lemma": _base(" SELECT * FROM contexts", hits),
        "kwic_exact": _base(" SELECT * FROM contexts", _HITS.replace("{hits}", "occurring WHERE token = 'orre'")),
        "word_tree_right": _base(" SELECT path, depth, count(*) AS n FROM paths GROUP BY ALL", hits, _TREE.replace("{branch}", "ws[spot + 1 : spot + 2]")),
        "word_tree_left": _base(
            " SELECT path, depth, count(*) AS n FROM paths GROUP BY ALL", hits, _TREE.replace("{branch}", "list_reverse(ws[greatest(spot - 2, 1) : spot - 1])")
        ),
        "sentiment_scores": _base(" SELECT * FROM labelled", _SPEECH),
        "sentiment_labels": _base(" SELECT label, count(*) AS n FROM labelled GROUP BY label", _SPEECH),
        "sentiment_by_lang": _base(" SELECT lang AS value, round(avg(score), 2) AS mean_score, count(*) AS n FROM labelled GROUP BY lang", _SPEECH),
        "emotions": "WITH" + _EMOTIONS + f" SELECT doc_id, {', '.join(inputs.CATEGORIES)} FROM emotions",
        "emotions_mean": "WITH" + _EMOTIONS + " " + means,
        "emotions_by_lang": "WITH" + _EMOTIONS + f" SELECT lang AS value, {curve} FROM emotions GROUP BY lang",
        "saturation_curve": _base(" SELECT * FROM curve", _CURVE),
        "saturation_point": _base(
            " SELECT min(k) AS k FROM curve WHERE new_ratio < 0.05 AND k > coalesce((SELECT max(k) FROM curve WHERE new_ratio >= 0.05), 0)", _CURVE
        ),
        "saturation_coverage": _base(
            f""", seeded AS (SELECT k, count(form) AS n FROM steps LEFT JOIN (SELECT * FROM entered WHERE form IN ({seeds})) e USING (k) GROUP BY k)
            SELECT k, round(sum(n) OVER (ORDER BY k) / {len(inputs.SEEDS['second'])}, 2) AS covered FROM seeded""",
            _CURVE,
        ),
        "starred_text": r"""
            SELECT doc_id AS uci_id, rtrim('**** ' || CASE WHEN trim(lang) <> '' THEN '*lang_' || regexp_replace(trim(lang), '\s+', '-', 'g') || ' ' ELSE '' END
                || CASE WHEN trim(source) <> '' THEN '*source_' || regexp_replace(trim(source), '\s+', '-', 'g') ELSE '' END) || chr(10) || text AS value
            FROM documents""",
        "segment_texts": _base(r" SELECT uce_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM segments"),
    }
    found["streaming_counts"] = found["token_counts"].replace(" AS token,", " AS form,").replace("SELECT token", "SELECT form").replace("AS token FROM", "AS form FROM").replace("GROUP BY token", "GROUP BY form")
    for index in INDICES:
        found[f"association_{index}"] = _base(f" SELECT form_i, form_j, a, f_i, f_j, round({_WEIGHTS[index]}, 6) AS weight FROM cooc", _TOP60)
    return found
