"""SQL of queries over spans and texts, for DuckDB: the same results by unnesting and windows. Only for tests and checks."""

from __future__ import annotations

from gridloom.llm import pii, quality_rules, secrets

_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents)"
#: The patterns as they are asked for; those of the operators differ in what keeps long runs linear.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BLANK = r"\x20\x09-\x0D"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(k: int, pattern: str) -> str:
    """(r, k, i, s, e, v) of the matches of a pattern."""
    p = _quoted(pattern)
    return (
        f"SELECT r, {k} AS k, i, (e - length(v))::BIGINT AS s, e, v FROM (SELECT r, i, v, sum(length(p) + length(v)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS e "
        f"FROM (SELECT r, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS v, unnest(p[1:len(h)]) AS p FROM (SELECT r, regexp_extract_all(t, {p}) AS h, string_split_regex(t, {p}) AS p FROM d)))"
    )


def _listed(names: list[str], where: str, table: str) -> str:
    name = "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    return f"(SELECT r, string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS x FROM {table} {where} GROUP BY r)"


def secret_scans() -> str:
    counts = ", ".join(f"(count(*) FILTER (WHERE k = {k}))::BIGINT AS n_{n}" for k, n in enumerate(secrets.KINDS[:3]))
    return rf"""
WITH {_DOCS},
base AS (SELECT * FROM (SELECT r, k, s, e, regexp_extract(v, {_quoted(_VALUE)}, 1) AS v FROM ({_matches(0, _ASSIGN)})) WHERE length(v) >= 12
         UNION ALL SELECT r, k, s, e, v FROM ({_matches(1, "AKIA[A-Z0-9]+")}) WHERE length(v) >= 18
         UNION ALL SELECT r, k, s, e, v FROM ({_matches(2, "[0-9a-f]+")}) WHERE length(v) >= 16),
loose AS (SELECT r, k, s, e, v FROM ({_matches(3, "[A-Za-z0-9+/_=-]+")}) AS x WHERE length(v) >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
candidate AS (SELECT x.*, coalesce(d.source, '') AS owner, concat_ws('/', d.source, d.lang) AS repository, len(list_distinct(string_split(v, ''))) >= {secrets.DISTINCT_CHARACTERS} AS random
              FROM (SELECT * FROM base UNION ALL SELECT * FROM loose) x JOIN d USING (r)),
spread AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM candidate GROUP BY v),
judged AS (SELECT c.*, owners, repositories, random AND owners <= {secrets.FEW_OWNERS} AND repositories <= {secrets.FEW_REPOSITORIES} AS live, owners >= {secrets.MANY_OWNERS} OR repositories >= {secrets.MANY_REPOSITORIES} AS copied FROM candidate c JOIN spread USING (v)),
per AS (SELECT r, {counts}, (count(*) FILTER (WHERE live))::BIGINT AS n_owned, (count(*) FILTER (WHERE copied))::BIGINT AS n_copied, max(owners)::BIGINT AS most_owners, max(repositories)::BIGINT AS most_repositories FROM judged GROUP BY r)
SELECT d.doc_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_owned", "n_copied", "most_owners", "most_repositories"))}, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM d LEFT JOIN per USING (r) LEFT JOIN {_listed(secrets.KINDS, "", "base")} b USING (r) LEFT JOIN {_listed(secrets.KINDS, "WHERE k < 3 OR live", "judged")} a USING (r)
"""


def private_data() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda x, i: CASE WHEN i % 2 = 0 THEN 2 * x::INT - 9 * (2 * x::INT > 9)::INT ELSE x::INT END)) % 10 = 0"
    small = "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0"
    counts = ", ".join(f"coalesce((SELECT count(*) FROM base b WHERE b.r = d.r AND k = {k}), 0)::BIGINT AS n_{n}" for k, n in enumerate(pii.KINDS[:4]))
    rounds = "".join(
        f"a{i} AS (SELECT p FROM graph LEFT JOIN k{i - 1} USING (v) GROUP BY p HAVING count(k{i - 1}.hit) >= {pii.MIN_KNOWN} AND count(k{i - 1}.hit) >= {pii.MIN_CONFIDENCE} * count(*)),\nk{i} AS (SELECT v, 1 AS hit FROM k{i - 1} UNION SELECT v, 1 FROM graph WHERE p IN (SELECT p FROM a{i})),\n" for i in range(1, pii.ROUNDS + 1)
    )
    return rf"""
WITH {_DOCS},
base AS (SELECT r, k, s, e FROM ({_matches(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")})
         UNION ALL SELECT r, k, s, e FROM ({_matches(1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")}) WHERE {small}
         UNION ALL SELECT r, k, s, e FROM ({_matches(2, r"[0-9](?:[\x20-]?[0-9])+")}) WHERE length({digits}) BETWEEN 12 AND 19 AND {luhn}
         UNION ALL SELECT r, k, s, e FROM ({_matches(3, r"\+[0-9][\x20().0-9-]+[0-9]")}) WHERE length({digits}) BETWEEN 9 AND 15),
word AS (SELECT *, lower(lag(v) OVER (PARTITION BY r ORDER BY i)) AS before, lower(lead(v) OVER (PARTITION BY r ORDER BY i)) AS after FROM ({_matches(4, f"[^{_BLANK}]+")})),
token AS (SELECT w.*, EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e) AS seed FROM word w WHERE contains(v, '@') OR length({digits}) >= 5),
pattern AS (SELECT r, s, e, v, seed, '<' || before AS p FROM token WHERE before IS NOT NULL UNION ALL SELECT r, s, e, v, seed, '>' || after FROM token WHERE after IS NOT NULL),
graph AS (SELECT p, v, bool_or(seed) AS seed FROM pattern GROUP BY p, v),
k0 AS (SELECT DISTINCT v, 1 AS hit FROM graph WHERE seed),
{rounds}found AS (SELECT r, k, s, e FROM base UNION ALL SELECT DISTINCT r, 4, s, e FROM pattern WHERE NOT seed AND p IN (SELECT p FROM a{pii.ROUNDS}))
SELECT d.doc_id, {counts}, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM d LEFT JOIN {_listed(pii.KINDS, "", "base")} b USING (r) LEFT JOIN {_listed(pii.KINDS, "", "found")} a USING (r)
"""


def quality() -> str:
    q = quality_rules

    def measured(rule: str) -> str:
        above, below = q.RULES[rule][0].split(" / ")
        return f"CASE WHEN {below} > 0 THEN {'-1.0' if above[0] == '-' else '1.0'}::DOUBLE * {above.lstrip('-')} / {below} ELSE -1e9 END"

    grid = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for i, (rule, (_, cuts)) in enumerate(q.RULES.items()) for c in cuts)
    values = " UNION ALL ".join(f"SELECT r, '{rule}' AS rule, {measured(rule)} AS x FROM stats" for rule in q.RULES)
    tail = f"list_sum(list_transform(range(0, run_rejected + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({q.RISK}) + (n_good - i) * ln(1 - {q.RISK}))))"
    return rf"""
WITH {_DOCS},
w AS (SELECT *, list_filter(string_split_regex(t, '[{_BLANK}]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l FROM d),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, unnest(range(len(w) - 4)) AS i, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g FROM w WHERE len(w) > 5)),
twice AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM gram WHERE n > 1) GROUP BY r),
stats AS (SELECT w.r, doc_id, coalesce(lang, '') AS stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(twice.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclamations
          FROM w LEFT JOIN twice ON w.r = twice.r),
grid AS (SELECT * FROM (VALUES {grid}) AS g (rule, nth, cutoff)),
v AS ({values}),
known AS (SELECT doc_id, max(quality)::INT AS label FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT r, stratum, label, ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 2 = 0 AS chooses FROM stats JOIN known USING (doc_id)),
counted AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE label = 1) AS n_good, count(*) FILTER (WHERE label <> 1) AS n_bad, count(*) FILTER (WHERE label = 1 AND x > cutoff) AS good, count(*) FILTER (WHERE label <> 1 AND x > cutoff) AS bad
            FROM held JOIN v USING (r) JOIN grid USING (rule) WHERE chooses GROUP BY ALL),
gained AS (SELECT *, bad::DOUBLE / greatest(n_bad, 1) - {q.GOOD_COST}::DOUBLE * good / greatest(n_good, 1) AS gain FROM counted),
best AS (SELECT stratum, rule, max_by(cutoff, (gain, cutoff)) AS cutoff, max(gain) AS gain FROM gained WHERE gain >= {q.MIN_GAIN} GROUP BY stratum, rule),
placed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place FROM best),
tested AS (SELECT h.stratum, h.r, min(p.place) FILTER (WHERE v.x > p.cutoff) AS first FROM held h JOIN placed p USING (stratum) JOIN v ON v.r = h.r AND v.rule = p.rule WHERE NOT chooses AND label = 1 GROUP BY h.stratum, h.r),
run AS (SELECT p.stratum, p.rule, p.cutoff, p.place, count(*) AS n_good, count(*) FILTER (WHERE t.first <= p.place) AS run_rejected FROM placed p JOIN tested t USING (stratum) GROUP BY ALL),
safe AS (SELECT stratum, max(place) AS longest FROM run WHERE run_rejected <= {q.RISK} * n_good AND {tail} <= {q.LEVEL} / ({len(q.RULES)} * greatest(1, (SELECT count(DISTINCT stratum) FROM held))) GROUP BY stratum),
cut AS (SELECT run.* FROM run JOIN safe USING (stratum) WHERE place <= longest),
failed AS (SELECT s.r, string_agg(DISTINCT v.rule, ',' ORDER BY v.rule) AS rules FROM stats s JOIN cut USING (stratum) JOIN v ON v.r = s.r AND v.rule = cut.rule WHERE v.x > cut.cutoff GROUP BY s.r),
verdict AS (SELECT s.*, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed, coalesce(rules, '') AS failed_rules FROM stats s LEFT JOIN failed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM verdict
"""
