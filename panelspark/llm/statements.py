"""The SQL that states the results of the operators that SQL can express."""

from __future__ import annotations

from panelspark.llm import filter_audit as filter_audit_, quality, secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secret_scans() -> str:
    """Matches and the gaps between them give the positions."""
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS nth, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {_text(r.pattern)}) AS f, "
        f"regexp_extract_all(t, {_text(r.pattern)}, {r.group}) AS v, string_split_regex(t, {_text(r.pattern)}) AS g "
        f"FROM d WHERE regexp_matches(t, {_text(r.pattern)})" for i, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(nth) FILTER (nth = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    joined = "coalesce(string_agg(span, ',' ORDER BY start, nth, stop){}, '')"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    matched AS ({found}),
    parts AS (SELECT rid, nth, kind, least, unnest(f) AS f, unnest(v) AS v, unnest(g[1:len(f)]) AS g,
                     unnest(range(1, len(f) + 1)) AS i FROM matched),
    placed AS (SELECT rid, nth, kind, CAST(sum(length(g) + length(f)) OVER (PARTITION BY rid, nth ORDER BY i) AS BIGINT) AS stop,
                      length(f) AS n, length(v) >= least AS counts FROM parts),
    spans AS (SELECT rid, nth, stop - n AS start, stop, kind || ':' || (stop - n) || ':' || stop AS span
              FROM placed WHERE counts)
    SELECT any_value(doc_id) AS doc_id, {counts},
           sha256({joined.format(f' FILTER (nth < {len(secrets.BASE)})')}) AS base_sha256, {joined.format('')} AS spans
    FROM d LEFT JOIN spans USING (rid) GROUP BY rid"""


def quality_rules() -> str:
    """Counts by windows over words; cutoffs by the binomial sum, from the logarithm of the gamma function."""
    word = _text(f"[^{quality.SPACE}]+")
    width, rules = quality.WINDOW, quality.RULES
    shares = {r: f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0 END" for r, (part, whole, _) in rules.items()}
    grid = " UNION ALL ".join(
        f"SELECT '{r}' AS rule, unnest({list(cutoffs)}::DOUBLE[]) AS cutoff, unnest(range({len(cutoffs)})) AS step"
        for r, (_, _, cutoffs) in rules.items())
    held = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {share} AS share FROM labelled" for r, share in shares.items())
    rate = quality.FALSE_REJECTIONS / len(rules)
    gram = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, width)]])
    hits = ", ".join(f"CASE WHEN {share} >= c.cutoffs['{r}'] THEN '{r}' END" for r, share in shares.items())
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
    listed AS (SELECT rid, regexp_extract_all(t, {word}) AS ws FROM d),
    words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM listed),
    grams AS (SELECT rid, i, {gram} AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
    often AS (SELECT rid, i FROM grams WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    covered AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + {width})) AS spot FROM often) s GROUP BY rid),
    lines AS (SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, {_text(f'[^{quality.SPACE}]')})] AS ls FROM d),
    counted AS MATERIALIZED (
      SELECT d.doc_id, d.stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, {_text(f'[^{quality.SYMBOLS}]+')}, '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_capitals,
             length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS n_letters,
             len(ws) < {quality.MIN_WORDS} OR 100 * coalesce(c.n, 0) > {quality.MAX_REPEAT_PERCENT} * len(ws) AS base_failed
      FROM d JOIN listed USING (rid) JOIN lines USING (rid) LEFT JOIN covered c USING (rid)),
    truth AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    labelled AS (SELECT c.*, good FROM counted c JOIN truth USING (doc_id) WHERE NOT base_failed),
    held AS ({held}),
    grid AS ({grid}),
    tests AS (
      SELECT stratum, rule, step, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND share >= cutoff) AS k,
             count(*) FILTER (good <> 1 AND share >= cutoff) AS caught
      FROM held JOIN grid USING (rule) GROUP BY ALL),
    tails AS (
      SELECT *, CASE WHEN k < n * {rate!r} THEN list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                  + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})) FOR i IN range(0, k + 1)]) ELSE 1 END AS p FROM tests),
    safe AS (
      SELECT *, caught - {quality.GOOD_WEIGHT} * k AS gain FROM tails
      QUALIFY bool_and(p <= {quality.ERROR_RATE!r} / {len(rules)} / (SELECT count(DISTINCT stratum) FROM labelled))
              OVER (PARTITION BY stratum, rule ORDER BY step)),
    chosen AS (SELECT stratum, map(list(rule), list(cutoff)) AS cutoffs FROM (
      SELECT * FROM safe WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1) b
      GROUP BY stratum),
    judged AS (
      SELECT k.*, array_to_string([x FOR x IN [{hits}] IF x IS NOT NULL], ',') AS rejected_by
      FROM counted k LEFT JOIN chosen c USING (stratum))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by,
           NOT base_failed AND rejected_by = '' AS kept FROM judged"""


def filter_audit() -> str:
    """Masks by plain conditions, copies by a window over equal texts, orders by a join of the letters with themselves."""
    word = _text("[^\\x20\\x09-\\x0D]+")
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(filter_audit_.FILTERS))
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM documents),
    masked AS MATERIALIZED (
      SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
    truth AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    counted AS MATERIALIZED (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
                FROM masked LEFT JOIN truth USING (doc_id) GROUP BY ALL),
    letters(f, bit) AS (VALUES {letters}),
    orders AS (SELECT f AS o, bit AS used FROM letters UNION ALL
               SELECT o || f, used + bit FROM orders JOIN letters ON used & bit = 0),
    whole AS (SELECT o FROM orders WHERE length(o) = 5),
    steps AS (SELECT o, i AS step, f, bit, coalesce((SELECT sum(b.bit) FROM letters b WHERE position(b.f IN substr(o, 1, i - 1)) > 0), 0)::INT AS before
              FROM whole, range(1, 6) r(i) JOIN letters ON f = substr(o, i, 1)),
    each AS (SELECT part, o, step, n, good, toxic, mask, bit, mask & bit <> 0 AS fails, mask & before <> 0 AS gone FROM counted, steps)
    SELECT part, o AS filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost,
           coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost,
           coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0)::BIGINT AS shapley
    FROM each GROUP BY part, o, step"""


def hard_negatives() -> str:
    """All anchors beside all rows."""
    return """
    WITH e AS MATERIALIZED (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
