"""The registered queries once more, as SQL for another engine.

Each statement is written from the meaning of the query, not from its plan:
plain joins where the library counts, windows where it cuts by prefix, sums over
lgamma where it multiplies ratios.
"""

from __future__ import annotations

from pairwright.functions.labels import KNOWN_SLUGS
from pairwright.functions.parsing import _SPACES
from pairwright.functions.statistics import _poisson_cuts
from pairwright.operators.items import judge_list
from pairwright.operators.subsets import JUDGE_QUOTAS, SHARED_QUOTAS
from pairwright.plans.catalog import SAMPLE_N, SEED
from pairwright.plans.views import CONDITIONS, CONFIG, JUDGES, LEXICON, PROMPTS, SKILL


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _bucket(salt: str, key: str, size: int) -> str:
    return f"(('0x' || substr(md5('{salt}/' || {key}), 1, 8))::BIGINT % {size})"


_SAID = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"


def _escaped(text: str) -> str:
    """A text inside a JSON string."""
    for raw, escape in (
        ("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "chr(92) || 'n'"),
        ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"),
    ):
        text = f"replace({text}, {raw}, {escape})"
    return text


# Every character that is stripped from both ends of a comment.
_BLANKS = " || ".join(f"chr({ord(c)})" for c in _SPACES)

_HUMAN = f"""
ids AS (SELECT *, 's_' || lang || '_' || doc_id::VARCHAR AS sample_id FROM documents),
chosen AS (
  SELECT *, {_bucket("choice", "sample_id", 100)} AS mood,
    CASE WHEN {_bucket("cm", "sample_id", 10)} >= 3 THEN {_SAID.format("text")} END AS commet FROM ids),
human AS (
  SELECT sample_id, lang AS lang_code, text AS source,
    replace(text, chr(10), ' ') AS text1, replace(text, ', ', ' ') AS text2,
    CASE WHEN mood < 52 THEN 'text1' WHEN mood < 97 THEN 'text2' WHEN mood < 99 THEN 'txt2' END AS choice,
    CASE WHEN mood < 99 AND (mood < 52) = ({_bucket("gold", "sample_id", 100)} >= 5)
      THEN 'text1' ELSE 'text2' END AS gold,
    CASE WHEN {_bucket("issue", "sample_id", 10)} < 2 THEN 'tone' END AS issues,
    commet, length(commet)::INTEGER AS comment_len, doc_id FROM chosen)"""

_ITEMS = f"""{_HUMAN},
items AS (
  SELECT sample_id, lang_code, source, text1 AS translation_a, text2 AS translation_b,
    CASE WHEN choice = 'text1' THEN 'A' ELSE 'B' END AS gold_winner, choice, issues,
    commet AS comment, doc_id FROM human)"""

_ROSTER = ", ".join(
    f"({_text(m)}, {_text(t)}, {SKILL[m]}, {i})" for i, (m, t) in enumerate(judge_list(CONFIG))
)
_CONDITIONS = ", ".join(f"({_text(p)}, {s}, {i})" for i, (p, s) in enumerate(CONDITIONS))

_CALLS = f"""{_ITEMS},
roster(model, tier, skill, judge_no) AS (VALUES {_ROSTER}),
conditions(prompt_version, swap_order, condition_no) AS (VALUES {_CONDITIONS}),
called AS (
  SELECT sample_id, lang_code, source, model, tier, skill, prompt_version, swap_order,
    CASE WHEN (gold_winner = 'A') <> swap_order THEN 'A' ELSE 'B' END AS gold_winner,
    doc_id * 100 + condition_no * 10 + judge_no AS row_ordinal,
    sample_id || '/' || model || '/' || prompt_version || '/'
      || CASE WHEN swap_order THEN 't' ELSE 'f' END AS key
  FROM items, roster, conditions),
sided AS (
  SELECT *, CASE WHEN ({_bucket("ok", "key", 100)} < skill) = (gold_winner = 'A') THEN 'A' ELSE 'B' END
    AS side FROM called)"""

_REPLIES = f"""{_CALLS},
shaped AS (SELECT *, {_bucket("fmt", "key", 100)} AS shape FROM sided),
replies AS (
  SELECT sample_id, lang_code, model, tier, prompt_version, swap_order, gold_winner, row_ordinal,
    CASE WHEN shape < 70 THEN '{{"winner":"' || side || '"}}'
      WHEN shape < 76 THEN '```json' || chr(10) || '{{ "winner" : "' || side || '" }}' || chr(10) || '```'
      WHEN shape < 80 THEN '{{"winner":"' || side || '"}} because it reads well'
      WHEN shape < 83 THEN '["' || side || '"]'
      WHEN shape < 85 THEN '{{"winner":"' || chr(92) || 'u004'
        || CASE WHEN side = 'A' THEN '1' ELSE '2' END || '"}}'
      WHEN shape < 91 THEN 'Translation ' || side || ' reads better'
      WHEN shape < 94 THEN 'no verdict' WHEN shape < 96 THEN '' END AS raw_response,
    CASE WHEN shape >= 98 THEN '429 Too Many Requests' END AS error
  FROM shaped)"""


def _json_field(field: str) -> str:
    return f"CASE WHEN json_valid(raw_response) THEN json_extract_string(raw_response, '$.{field}') END"


_WINNER_KEY = """nullif(regexp_extract(raw_response, '"winner"\\s*:\\s*"([AB])"', 1), '')"""


def _parsed(strict: bool = False) -> str:
    bare = "NULL" if strict else "nullif(regexp_extract(raw_response, '\\b([AB])\\b', 1), '')"
    return f"""{_REPLIES},
steps AS (
  SELECT *, {_json_field("winner")} AS w_json, {_WINNER_KEY} AS w_key, {bare} AS w_bare FROM replies),
parsed AS (
  SELECT * EXCLUDE (w_json, w_key, w_bare),
    CASE WHEN w_json IN ('A', 'B') THEN w_json ELSE coalesce(w_key, w_bare) END AS parsed_winner,
    CASE WHEN w_json IN ('A', 'B') THEN 'json' WHEN w_key IS NOT NULL THEN 'key_regex'
      WHEN w_bare IS NOT NULL THEN 'bare_letter' ELSE 'none' END AS parse_method FROM steps)"""


_JUDGED = f"""{_parsed()},
judged AS (
  SELECT *, parsed_winner IS NOT NULL AS parse_success, parsed_winner = gold_winner AS is_correct
  FROM parsed),
main AS (SELECT * FROM judged WHERE parse_success AND prompt_version = 'main' AND NOT swap_order),
swapped AS (SELECT * FROM judged WHERE parse_success AND prompt_version = 'main' AND swap_order),
minimal AS (SELECT * FROM judged WHERE parse_success AND prompt_version = 'minimal')"""

_COMMENTS = f"""{_CALLS},
shaped AS (
  SELECT *, {_bucket("cfmt", "key", 100)} AS shape,
    {_escaped(_SAID.format("source"))} AS words,
    '{{"winner":"' || side || '","comment":"' AS head
  FROM sided WHERE prompt_version = 'main' AND NOT swap_order),
comment_replies AS (
  SELECT sample_id, lang_code, model, tier, gold_winner, row_ordinal,
    ['incorrect', 'unstable', 'control'][({_bucket("case", "key", 3)} + 1)::INTEGER] AS comment_case_type,
    CASE WHEN shape < 60 THEN head || words || '"}}'
      WHEN shape < 70 THEN head || 'so ' || chr(92) || '"fine' || chr(92) || '": ' || words || '"}}'
      WHEN shape < 80 THEN 'Sure. ' || head || ' ' || words || ' ' || chr(10) || '" }}'
      WHEN shape < 90 THEN head || words
      WHEN shape < 95 THEN 'Translation ' || side || ' is better' END AS raw_response
  FROM shaped),
comment_steps AS (
  SELECT *, {_json_field("winner")} AS w_json, {_json_field("comment")} AS c_json,
    {_WINNER_KEY} AS w_key,
    nullif(regexp_extract(raw_response, '(?s)"comment"\\s*:\\s*"(.+?)"\\s*\\}}', 1), '') AS c_key
  FROM comment_replies),
comments AS (
  SELECT * EXCLUDE (w_json, c_json, w_key, c_key),
    CASE WHEN w_json IN ('A', 'B') THEN w_json ELSE w_key END AS parsed_winner,
    CASE WHEN w_json IN ('A', 'B') THEN c_json ELSE trim(c_key, {_BLANKS}) END AS comment
  FROM comment_steps)"""


def _with_stats(counts: str, keys: str, p_value: bool = False) -> str:
    """``rated``: the rows of ``counts`` (keys, n, k) with interval bounds and log10 p."""
    test = f""",
tails AS (
  SELECT {keys}, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2) AS lp
  FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM {counts})),
tested AS (
  SELECT {keys}, (max(lp) + ln(sum(exp(lp - top)))) / ln(10) AS binom_log10_p
  FROM (SELECT *, max(lp) OVER (PARTITION BY {keys}) AS top FROM tails) GROUP BY {keys})"""
    return f""",
masses AS (
  SELECT {keys}, n, i, CASE WHEN k = 0 THEN (i = 0)::INTEGER::DOUBLE
      WHEN k = n THEN (i = n)::INTEGER::DOUBLE
      ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln(k::DOUBLE / n) + (n - i) * ln(1 - k::DOUBLE / n)) END AS mass
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM {counts})),
cumulated AS (
  SELECT {keys}, n, i, sum(mass) OVER (PARTITION BY {keys} ORDER BY i) AS below FROM masses),
bounds AS (
  SELECT {keys}, round(min(i) FILTER (below >= 0.025) / any_value(n), 6) AS ci_lower,
    round(min(i) FILTER (below >= 0.975) / any_value(n), 6) AS ci_upper
  FROM cumulated GROUP BY {keys}){test if p_value else ""},
rated AS (
  SELECT * FROM {counts} JOIN bounds USING ({keys}) {f"JOIN tested USING ({keys})" if p_value else ""})"""


_AGREEMENT = f"""{_JUDGED},
counts AS (SELECT model, count(*) AS n, count(*) FILTER (is_correct) AS k FROM main GROUP BY model)"""


def _matched(left: str, right: str, keys: str, other: str, flag: str, sign: str) -> str:
    return f"""
matched AS (
  SELECT {", ".join("m." + k for k in keys.split(", "))}, m.lang_code,
    m.parsed_winner AS winner_main, s.parsed_winner AS {other},
    (m.parsed_winner {sign} s.parsed_winner)::INTEGER AS {flag}
  FROM {left} m JOIN {right} s USING ({keys}))"""


_SWAP_KEYS = "sample_id, model, prompt_version"
_SWAP = f"{_JUDGED}, {_matched('main', 'swapped', _SWAP_KEYS, 'winner_swap', 'swap_consistent', '<>')}"
_PROMPT = (
    f"{_JUDGED}, "
    f"{_matched('main', 'minimal', 'sample_id, model', 'winner_minimal', 'prompt_consistent', '=')}"
)
_REPEATED = f"""{_JUDGED},
main_q AS (SELECT * REPLACE ('q_' || ((row_ordinal // 100) % 7)::VARCHAR AS sample_id) FROM main),
swapped_q AS (SELECT * REPLACE ('q_' || ((row_ordinal // 100) % 7)::VARCHAR AS sample_id) FROM swapped),
{_matched('main_q', 'swapped_q', _SWAP_KEYS, 'winner_swap', 'swap_consistent', '<>')}"""


def _pairs(base: str, keys: str, other: str, flag: str, kind: str = "BIGINT") -> str:
    return f"""WITH {base}
SELECT {keys}, winner_main, lang_code, {other}, {flag}, count(*)::{kind} AS pairs FROM matched GROUP BY ALL"""


def _summary(base: str, flag: str, rate: str, kind: str = "BIGINT") -> str:
    return f"""WITH {base},
counts AS (
  SELECT "group", model, count({flag}) AS n, sum({flag})::BIGINT AS k FROM (
    SELECT 'overall' AS "group", model, {flag} FROM matched
    UNION ALL SELECT 'lang=' || lang_code, model, {flag} FROM matched) GROUP BY ALL)
{_with_stats("counts", '"group", model')}
SELECT "group", model, n::{kind} AS n, round(k / n, 6) AS {rate}, ci_lower, ci_upper FROM rated"""


def _draw_key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{SEED}'", *parts]) + "))"


_STRATIFIED = f"""{_ITEMS},
sized AS (
  SELECT sample_id, lang_code, count(*) OVER (PARTITION BY lang_code) AS size, count(*) OVER () AS total,
    row_number() OVER (PARTITION BY lang_code
      ORDER BY {_draw_key("lang_code", "sample_id")}, sample_id) AS rn FROM items),
picked AS (
  SELECT sample_id FROM sized WHERE rn <= greatest(1, round_even({SAMPLE_N} * size / total, 0)))"""
_EXACT = f"""{_STRATIFIED},
kept AS (
  SELECT sample_id FROM items ORDER BY
    (sample_id IN (SELECT sample_id FROM picked)) DESC, {_draw_key("'exact'", "sample_id")}, sample_id
  LIMIT {SAMPLE_N})"""

_ITEM_COLUMNS = (
    "sample_id, lang_code, source, translation_a, translation_b, gold_winner, choice, issues, comment"
)

_UNSTABLE = """
unstable AS (
  SELECT DISTINCT m.model, m.sample_id FROM main m JOIN swapped s USING (model, sample_id)
  WHERE s.parsed_winner <> CASE WHEN m.parsed_winner = 'A' THEN 'B' ELSE 'A' END),
incorrect AS (SELECT DISTINCT model, sample_id FROM main WHERE NOT is_correct)"""

_CONTROLS = f"""{_JUDGED}, {_UNSTABLE},
controls AS (
  SELECT model, sample_id FROM items, roster
  EXCEPT (SELECT model, sample_id FROM unstable UNION SELECT model, sample_id FROM incorrect))"""


def _cases(quotas: dict[str, int], by: str) -> str:
    """``labelled`` from ``pool``: draw up to the quota of each case, first case wins."""
    keys = ", ".join([*([by] if by else []), "sample_id"])
    strata = ", ".join([*([by] if by else []), '"case"'])
    values = ", ".join(f"('{c}', {n}, {i})" for i, (c, n) in enumerate(quotas.items()))
    key = _draw_key(*([by] if by else []), '"case"', "sample_id")
    return f""",
quotas("case", quota, priority) AS (VALUES {values}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {key}, sample_id) AS rn
  FROM pool JOIN quotas USING ("case")),
labelled AS (
  SELECT {keys}, arg_min("case", priority) AS comment_case_type FROM ranked WHERE rn <= quota GROUP BY ALL)"""


_FIRST_TWO = ", ".join(_text(m) for m in JUDGES[:2])
_DISAGREE = f"""
disagree AS (
  SELECT d.sample_id, d.parsed_winner AS first_winner, g.parsed_winner AS second_winner
  FROM main d JOIN main g USING (sample_id)
  WHERE d.model = {_text(JUDGES[0])} AND g.model = {_text(JUDGES[1])}
    AND d.parsed_winner <> g.parsed_winner)"""


def _slug(model: str) -> str:
    known = " ".join(f"WHEN {_text(m)} THEN {_text(s)}" for m, s in KNOWN_SLUGS.items())
    return f"CASE {model} {known} ELSE translate(lower({model}), '/:-. ', '_____') END"


_NAMES = f"""
names AS (
  SELECT doc_id, CASE {_bucket("name", "doc_id::VARCHAR", 4)}
    WHEN 0 THEN 'openai/gpt-5.4-pro' WHEN 1 THEN 'x-ai/grok-4.20-beta'
    ELSE source || '/' || upper(lang[1]) || lang[2:] || '-v' || doc_id::VARCHAR
      || '.1 pro:free' || chr(92) || 'x' END AS model
  FROM documents)"""


def _message(a: str, b: str) -> str:
    return (
        f"'Source passage:' || chr(10) || source || chr(10) || chr(10) || 'Translation A:' || chr(10) || {a}"
        f" || chr(10) || chr(10) || 'Translation B:' || chr(10) || {b}"
        " || chr(10) || chr(10) || 'Which translation is better overall?'"
    )


def _merged() -> str:
    slugs = {m: m.lower().translate(str.maketrans("/:-. ", "_____")) for m in JUDGES}
    joins = "\n".join(
        f"LEFT JOIN comments c{i} ON c{i}.sample_id = items.sample_id AND c{i}.model = {_text(m)}"
        for i, m in enumerate(JUDGES)
    )
    columns = ", ".join(
        f"c{i}.comment_case_type AS {s}_comment_case_type, c{i}.parsed_winner AS {s}_winner, "
        f"c{i}.comment AS {s}_comment, c{i}.model AS {s}_model, c{i}.lang_code AS {s}_lang_code, "
        f"(c{i}.parsed_winner = c{i}.gold_winner) AS {s}_is_correct, "
        f"(c{i}.parsed_winner IS NOT NULL) AS {s}_parse_success"
        for i, s in enumerate(slugs.values())
    )
    some = ", ".join(f"c{i}.comment" for i in range(len(JUDGES)))
    return f"""WITH {_COMMENTS}
SELECT items.sample_id, items.lang_code, items.source, translation_a, translation_b, items.gold_winner,
  h.commet AS human_comment, h.issues AS human_issues, h.comment_len AS human_comment_len,
  h.choice, h.gold, {columns}
FROM items LEFT JOIN human h ON h.sample_id = items.sample_id
{joins}
WHERE coalesce({some}) IS NOT NULL"""


_MENTIONS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, [{', '.join(map(_text, terms))}] AS terms" for d, terms in LEXICON.items()
)
_DIMENSIONS = f"""{_COMMENTS},
said AS (
  SELECT 'human' AS source, sample_id, commet AS comment FROM human
  UNION ALL SELECT {_slug("model")}, sample_id, comment FROM comments),
lexicon AS ({_MENTIONS}),
worded AS (
  SELECT source, sample_id,
    ' ' || array_to_string(regexp_extract_all(lower(comment), '[\\p{{L}}\\p{{M}}]+'), ' ') || ' ' AS words
  FROM said WHERE comment IS NOT NULL),
dims AS (
  SELECT source, dimension, count(DISTINCT sample_id) FILTER (
    len(list_filter(terms, lambda term: contains(words, ' ' || term || ' '))) > 0) AS cnt
  FROM worded, lexicon GROUP BY ALL),
shares AS (
  SELECT source, dimension, cnt, cnt / nullif(sum(cnt) OVER (PARTITION BY source), 0) AS share FROM dims)"""

_LEADERBOARD_PART = """
{p}_counts AS (SELECT model, count(*) AS n, sum({flag})::BIGINT AS k FROM {table} GROUP BY model),
{p}_mass AS (
  SELECT model, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln(k::DOUBLE / n) + (n - i) * ln(1 - k::DOUBLE / n)) AS mass
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM {p}_counts)),
{p} AS (
  SELECT model, round(100.0::DOUBLE * k / n, 1) AS {p}_pct,
    round(100.0::DOUBLE * (min(i) FILTER (below >= 0.025)) / n, 1) AS {p}_ci_lower_pct,
    round(100.0::DOUBLE * (min(i) FILTER (below >= 0.975)) / n, 1) AS {p}_ci_upper_pct, n AS {p}_n
  FROM (SELECT *, sum(mass) OVER (PARTITION BY model ORDER BY i) AS below FROM {p}_mass)
    JOIN {p}_counts USING (model, n) GROUP BY model, k, n)"""


def _leaderboard() -> str:
    parts = [
        _LEADERBOARD_PART.format(p="validity", flag="is_correct::INTEGER", table="main"),
        _LEADERBOARD_PART.format(p="swap", flag="ok", table="swap_pairs"),
        _LEADERBOARD_PART.format(p="prompt", flag="ok", table="prompt_pairs"),
    ]
    return f"""WITH {_JUDGED},
swap_pairs AS (
  SELECT model, (m.parsed_winner <> s.parsed_winner)::INTEGER AS ok
  FROM main m JOIN swapped s USING ({_SWAP_KEYS})),
prompt_pairs AS (
  SELECT model, (m.parsed_winner = s.parsed_winner)::INTEGER AS ok
  FROM main m JOIN minimal s USING (sample_id, model)),
{",".join(parts)}
SELECT * FROM validity LEFT JOIN swap USING (model) LEFT JOIN prompt USING (model)"""


_FIRSTS = f"""{_JUDGED},
firsts AS (
  SELECT sample_id, model, prompt_version,
    arg_min(parsed_winner, row_ordinal) FILTER (NOT swap_order) AS winner_plain,
    arg_min(parsed_winner, row_ordinal) FILTER (swap_order) AS winner_swapped,
    arg_min(parsed_winner, row_ordinal) AS winner
  FROM judged WHERE parse_success GROUP BY ALL)"""

_STUB = f"""{_ITEMS},
roster(model, tier, skill, judge_no) AS (VALUES {_ROSTER}),
answered AS (
  SELECT sample_id, lang_code, model, tier, 'main' AS prompt_version, false AS swap_order, gold_winner,
    substr(md5(model || '|' || {_message("translation_a", "translation_b")}), 1, 1) AS digit
  FROM items, roster)"""


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    prompts = {k: _text(v) for k, v in PROMPTS.items()}
    counts_by_three = f"""{_JUDGED},
counts AS (
  SELECT model, prompt_version, lang_code, count(*) AS n, count(*) FILTER (is_correct) AS k
  FROM judged WHERE parse_success GROUP BY ALL)"""
    three = "model, prompt_version, lang_code"
    return {
        "build_items": f"WITH {_ITEMS} SELECT {_ITEM_COLUMNS} FROM items",
        "swapped_items": f"""WITH {_ITEMS}
SELECT sample_id, lang_code, source, translation_b AS translation_a, translation_a AS translation_b,
  CASE WHEN gold_winner = 'A' THEN 'B' ELSE 'A' END AS gold_winner, choice, issues, comment FROM items""",
        "dedupe_first": """
SELECT md5(text) AS sample_id, doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""",
        "flag_conflicts": f"""WITH {_HUMAN}
SELECT * EXCLUDE (doc_id) FROM human WHERE choice IS NULL OR choice <> gold""",
        "judge_requests": f"""WITH {_ITEMS}, roster(model, tier, skill, judge_no) AS (VALUES {_ROSTER})
SELECT sample_id, lang_code, 'main' AS prompt_version, true AS swap_order,
  CASE WHEN gold_winner = 'A' THEN 'B' ELSE 'A' END AS gold_winner, {prompts["main"]} AS system_prompt,
  {_message("translation_b", "translation_a")} AS user_message, model, tier FROM items, roster""",
        "judge_roster": f"""WITH roster(model, tier, skill, judge_no) AS (VALUES {_ROSTER})
SELECT model, tier, count(*) AS requests FROM documents, roster GROUP BY ALL""",
        "model_safe_name": f"""WITH {_NAMES}
SELECT doc_id, model, replace(replace(replace(model, '/', '_'), ':', '_'), chr(92), '_') AS safe_name
FROM names""",
        "judge_slug": f"WITH {_NAMES} SELECT doc_id, model, {_slug('model')} AS slug FROM names",
        "jsonl_round_trip": f"""WITH {_JUDGED}
SELECT sample_id, lang_code, model, tier, prompt_version, swap_order, gold_winner, parsed_winner, parse_success,
  is_correct, raw_response, error FROM judged WHERE prompt_version = 'main' AND NOT swap_order""",
        "run_judges": f"""WITH {_STUB},
scored AS (
  SELECT *, CASE WHEN digit = 'f' THEN NULL WHEN digit < '8' THEN 'A' ELSE 'B' END AS parsed_winner
  FROM answered)
SELECT sample_id, lang_code, model, tier, prompt_version, swap_order, gold_winner, parsed_winner,
  parsed_winner IS NOT NULL AS parse_success, parsed_winner = gold_winner AS is_correct,
  '{{"winner":"' || parsed_winner || '"}}' AS raw_response,
  CASE WHEN digit = 'f' THEN '429 Too Many Requests' END AS error FROM scored""",
        "run_comment_judges": f"""WITH {_STUB},
scored AS (
  SELECT *, CASE WHEN digit = 'f' THEN NULL WHEN digit < '8' THEN 'A' ELSE 'B' END AS parsed_winner
  FROM answered)
SELECT sample_id, ['incorrect', 'unstable', 'control'][({_bucket("case", "sample_id", 3)} + 1)::INTEGER]
    AS comment_case_type, lang_code, model, tier, 'comment' AS prompt_version, gold_winner, parsed_winner,
  parsed_winner IS NOT NULL AS parse_success, parsed_winner = gold_winner AS is_correct,
  CASE WHEN digit <> 'f' THEN 'because of ' || digit END AS comment,
  '{{"winner":"' || parsed_winner || '","comment":"because of ' || digit || '"}}' AS raw_response,
  CASE WHEN digit = 'f' THEN '429 Too Many Requests' END AS error FROM scored""",
        "pending_requests": f"""WITH {_JUDGED}
SELECT sample_id, lang_code, model, tier, prompt_version, swap_order FROM judged
WHERE NOT parse_success AND prompt_version = 'main' AND NOT swap_order""",
        "parse_winner": f"""WITH {_parsed()}
SELECT {_SWAP_KEYS}, swap_order, raw_response, parsed_winner, parse_method FROM parsed""",
        "parse_winner_strict": f"""WITH {_parsed(strict=True)}
SELECT {_SWAP_KEYS}, swap_order, parsed_winner, parse_method FROM parsed""",
        "parse_method_mix": f"""WITH {_parsed()}
SELECT model, parse_method, count(*) AS n FROM parsed GROUP BY ALL""",
        "parse_comment": f"WITH {_COMMENTS} SELECT sample_id, model, parsed_winner, comment FROM comments",
        "score_judgments": f"""WITH {_JUDGED}
SELECT {_SWAP_KEYS}, swap_order, gold_winner, parsed_winner, parse_success, is_correct FROM judged""",
        "parse_coverage": f"""WITH {_JUDGED}
SELECT model, prompt_version, swap_order, count(*) AS n_rows, count(raw_response) AS n_replies,
  count(*) FILTER (raw_response IS NULL AND error IS NULL) AS n_empty, count(error) AS n_errors,
  count(*) FILTER (parse_success) AS n_effective,
  round(count(*) FILTER (parse_success) / count(*), 6) AS parse_rate FROM judged GROUP BY ALL""",
        "agreement_by_model": f"""WITH {_AGREEMENT}{_with_stats("counts", "model", p_value=True)}
SELECT model, n, round(k / n, 6) AS agreement_rate, ci_lower, ci_upper,
  round(binom_log10_p, 4) AS binom_log10_p FROM rated""",
        "swap_matched": _pairs(_SWAP, _SWAP_KEYS, "winner_swap", "swap_consistent"),
        "swap_matched_rows": f"""WITH {_SWAP}
SELECT {_SWAP_KEYS}, winner_main, lang_code, winner_swap, swap_consistent FROM matched""",
        "swap_matched_repeated": _pairs(_REPEATED, _SWAP_KEYS, "winner_swap", "swap_consistent", "DOUBLE"),
        "swap_consistency_repeated": _summary(_REPEATED, "swap_consistent", "swap_consistency_rate", "DOUBLE"),
        "prompt_matched": _pairs(_PROMPT, "sample_id, model", "winner_minimal", "prompt_consistent"),
        "swap_consistency": _summary(_SWAP, "swap_consistent", "swap_consistency_rate"),
        "prompt_consistency": _summary(_PROMPT, "prompt_consistent", "prompt_consistency_rate"),
        "swap_single_file": f"""WITH {_FIRSTS},
counts AS (
  SELECT model, count(*) AS n, count(*) FILTER (winner_plain <> winner_swapped) AS k FROM firsts
  WHERE winner_plain IS NOT NULL AND winner_swapped IS NOT NULL GROUP BY model)
{_with_stats("counts", "model")}
SELECT model, n, round(k / n, 6) AS swap_consistency_rate, ci_lower, ci_upper FROM rated""",
        "prompt_single_file": f"""WITH {_FIRSTS},
base AS (SELECT model, min(prompt_version) AS base_prompt FROM firsts GROUP BY model),
counts AS (
  SELECT o.model, base_prompt, o.prompt_version AS other_prompt, count(*) AS n,
    count(*) FILTER (o.winner = b.winner) AS k
  FROM firsts o JOIN base USING (model) JOIN firsts b
    ON b.model = o.model AND b.sample_id = o.sample_id AND b.prompt_version = base_prompt
  WHERE o.prompt_version <> base_prompt GROUP BY ALL)
{_with_stats("counts", "model, base_prompt, other_prompt")}
SELECT model, base_prompt, other_prompt, n, round(k / n, 6) AS prompt_consistency_rate,
  ci_lower, ci_upper FROM rated""",
        "verdict_pivot": f"WITH {_FIRSTS} SELECT {_SWAP_KEYS}, winner_plain, winner_swapped FROM firsts",
        "judge_leaderboard": _leaderboard(),
        "common_judges": f"""WITH {_JUDGED}
SELECT DISTINCT model FROM judged WHERE prompt_version = 'main' AND NOT swap_order AND tier <> 'unknown'
INTERSECT SELECT DISTINCT model FROM judged
WHERE prompt_version = 'main' AND swap_order AND model <> 'east/judge-3'""",
        "run_summary": f"""WITH {_JUDGED}
SELECT count(*) FILTER (NOT swap_order) AS n_main_rows, count(*) FILTER (swap_order) AS n_other_rows,
  string_agg(DISTINCT model, '; ' ORDER BY model) AS models_compared
FROM judged WHERE prompt_version = 'main'""",
        "metrics_summary": f"""WITH {_FIRSTS},
base AS (SELECT model, min(prompt_version) AS base_prompt FROM firsts GROUP BY model)
SELECT (SELECT count(DISTINCT model) FROM main) AS main_metrics_rows,
  (SELECT count(DISTINCT model) FROM firsts
    WHERE winner_plain IS NOT NULL AND winner_swapped IS NOT NULL) AS swap_metrics_rows,
  (SELECT count(*) FROM (SELECT DISTINCT o.model, o.prompt_version
    FROM firsts o JOIN base USING (model) JOIN firsts b
      ON b.model = o.model AND b.sample_id = o.sample_id AND b.prompt_version = base_prompt
    WHERE o.prompt_version <> base_prompt)) AS prompt_metrics_rows""",
        "union_runs": f"""
SELECT * FROM (WITH {_JUDGED} SELECT {_SWAP_KEYS}, swap_order, parsed_winner, NULL::VARCHAR
    AS comment_case_type FROM judged)
UNION ALL SELECT * FROM (WITH {_COMMENTS} SELECT sample_id, model, 'comment' AS prompt_version,
    NULL::BOOLEAN AS swap_order, parsed_winner, comment_case_type FROM comments)""",
        "binom_test": f"""WITH {counts_by_three}{_with_stats("counts", three, p_value=True)}
SELECT {three}, n, k, round(binom_log10_p, 4) AS binom_log10_p FROM rated""",
        "bootstrap_ci_exact": f"""WITH {counts_by_three}{_with_stats("counts", three)}
SELECT {three}, n, k, ci_lower, ci_upper FROM rated""",
        "bootstrap_ci_hash": f"""WITH {_AGREEMENT}{_with_stats("counts", "model")},
uniforms AS (
  SELECT (('0x' || substr(md5('{SEED}|' || b::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52} AS u
  FROM range(0, 2000) r(b)),
draws AS (
  SELECT model, min(i) / any_value(n) AS mean FROM uniforms JOIN cumulated ON below >= u GROUP BY model, u)
SELECT model, round(quantile_cont(mean, 0.025), 6) AS ci_lower,
  round(quantile_cont(mean, 0.975), 6) AS ci_upper FROM draws GROUP BY model""",
        "bootstrap_ci_numeric": f"""WITH {_HUMAN},
hashed AS (
  SELECT lang_code, comment_len, block, md5('{SEED}|' || block::VARCHAR || '|' || sample_id) AS h
  FROM human, range(0, 50) r(block) WHERE comment_len IS NOT NULL),
drawn AS (
  SELECT lang_code, comment_len, block, j, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT AS u
  FROM hashed, range(0, 4) s(j)),
means AS (
  SELECT lang_code, sum(w * comment_len) / sum(w) AS mean
  FROM (SELECT *, len(list_filter([{", ".join(map(str, _poisson_cuts()))}], lambda cut: u >= cut)) AS w FROM drawn)
  GROUP BY lang_code, block, j HAVING sum(w) > 0),
bounds AS (
  SELECT lang_code, quantile_cont(mean, 0.025) AS ci_lower, quantile_cont(mean, 0.975) AS ci_upper
  FROM means GROUP BY lang_code)
SELECT lang_code, count(*) AS n, round(avg(comment_len), 6) AS mean, round(any_value(ci_lower), 6) AS ci_lower,
  round(any_value(ci_upper), 6) AS ci_upper
FROM human JOIN bounds USING (lang_code) WHERE comment_len IS NOT NULL GROUP BY lang_code""",
        "simple_sample": f"""WITH {_ITEMS}
SELECT {_ITEM_COLUMNS} FROM items ORDER BY {_draw_key("sample_id")}, sample_id LIMIT {SAMPLE_N}""",
        "stratified_sample": f"""WITH {_STRATIFIED}
SELECT {_ITEM_COLUMNS} FROM items WHERE sample_id IN (SELECT sample_id FROM picked)""",
        "stratified_exact": f"""WITH {_EXACT}
SELECT {_ITEM_COLUMNS} FROM items WHERE sample_id IN (SELECT sample_id FROM kept)""",
        "subset_distribution": f"""WITH {_EXACT}
SELECT lang_code, count(*) AS n FROM items WHERE sample_id IN (SELECT sample_id FROM kept)
GROUP BY lang_code""",
        "incorrect_items": f"WITH {_JUDGED}, {_UNSTABLE} SELECT model, sample_id FROM incorrect",
        "incorrect_any_judge": f"""WITH {_JUDGED}
SELECT DISTINCT sample_id FROM main WHERE NOT is_correct AND model IN ({_FIRST_TWO})""",
        "unstable_items": f"WITH {_JUDGED}, {_UNSTABLE} SELECT model, sample_id FROM unstable",
        "judge_disagreement": f"""WITH {_JUDGED}, {_DISAGREE}
SELECT sample_id, first_winner, second_winner, count(*) AS pairs FROM disagree GROUP BY ALL""",
        "control_pool": f"WITH {_CONTROLS} SELECT model, sample_id FROM controls",
        "silent_judges": f"""WITH {_JUDGED}
SELECT model, 0::BIGINT AS rows FROM (VALUES {_ROSTER}) r(model, tier, skill, judge_no)
WHERE model NOT IN (SELECT model FROM judged WHERE parse_success AND prompt_version = 'main'
  AND tier <> 'unknown' AND model <> 'east/judge-3')""",
        "comment_subset_judge": f"""WITH {_CONTROLS},
pool AS (
  SELECT *, 'incorrect' AS "case" FROM incorrect UNION ALL SELECT *, 'unstable' FROM unstable
  UNION ALL SELECT *, 'control' FROM controls)
{_cases(JUDGE_QUOTAS, "model")}
SELECT model AS comment_target_model, sample_id, lang_code, gold_winner, comment_case_type
FROM items JOIN labelled USING (sample_id)""",
        "comment_subset_shared": f"""WITH {_JUDGED}, {_UNSTABLE}, {_DISAGREE},
bad AS (
  SELECT DISTINCT sample_id, 'incorrect' AS "case" FROM incorrect WHERE model IN ({_FIRST_TWO})
  UNION ALL SELECT DISTINCT sample_id, 'unstable' FROM unstable WHERE model IN ({_FIRST_TWO})
  UNION ALL SELECT DISTINCT sample_id, 'disagreement' FROM disagree),
pool AS (
  SELECT * FROM bad UNION ALL
  SELECT sample_id, 'control' FROM items WHERE sample_id NOT IN (SELECT sample_id FROM bad))
{_cases(SHARED_QUOTAS, "")}
SELECT sample_id, lang_code, gold_winner, comment_case_type FROM items JOIN labelled USING (sample_id)""",
        "merge_comments": _merged(),
        "merge_comments_hot": f"""WITH {_COMMENTS},
hot AS (SELECT arg_min(sample_id, doc_id) AS first FROM human),
people AS (
  SELECT CASE WHEN {_bucket("hot", "sample_id", 3)} = 0 THEN first ELSE sample_id END AS sample_id, commet, issues, choice
  FROM human, hot),
said AS (SELECT sample_id FROM comments WHERE comment IS NOT NULL GROUP BY sample_id)
SELECT i.sample_id, p.commet AS human_comment, p.issues AS human_issues, p.choice,
  c.parsed_winner AS north_judge_1_0_winner
FROM items i JOIN said USING (sample_id) LEFT JOIN people p ON p.sample_id = i.sample_id
LEFT JOIN comments c ON c.sample_id = i.sample_id AND c.model = {_text(JUDGES[0])}""",
        "dimension_counts": f"WITH {_DIMENSIONS} SELECT source, dimension, cnt FROM dims",
        "dimension_share": f"""WITH {_DIMENSIONS}
SELECT source, dimension, cnt, round(share, 6) AS share FROM shares""",
        "dimension_axis": f"""WITH {_DIMENSIONS},
bound AS (SELECT max(share) + 0.005 AS upper FROM shares)
SELECT round(upper, 6) AS upper, level, round(upper * level / 5, 6) AS tick
FROM (SELECT upper, unnest(range(1, 6))::INTEGER AS level FROM bound)""",
    }
