"""DuckDB SQL for the queries of the text operators that SQL can express."""

import math

from termeval.llm import licence_digest, url_trust
from termeval.llm.licence_texts import LICENCES
from termeval.llm.queries import RULES

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# As many steps as it takes until no value can change by the tolerance.
_STEPS = math.ceil(math.log(url_trust.TOLERANCE / (1 - url_trust.DAMPING)) / math.log(url_trust.DAMPING))


def _url_trust() -> str:
    rules = ", ".join(f"({quoted(rule)}, {quoted(verdict)})" for rule, verdict in RULES)
    steps = ""
    for i in range(1, _STEPS + 1):
        steps += f""",
    r{i} AS MATERIALIZED (SELECT kind, host, sum(value) AS value FROM (
        SELECT * FROM r0 UNION ALL
        SELECT f.kind, f.host, {url_trust.DAMPING} * share * value FROM flows f
        JOIN r{i - 1} r ON r.kind = f.kind AND r.host = f.source) GROUP BY ALL)"""
    return rf"""
    WITH rules(rule, verdict) AS (VALUES {rules}),
    split_rules AS (
        SELECT rule, verdict, split_part(rule, '/', 1) AS domain,
               substr(rule, length(split_part(rule, '/', 1)) + 1) AS start FROM rules),
    parsed AS (
        SELECT page_id, html,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                        '{url_trust.UPPER}', '{url_trust.LOWER}'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fits AS (
        SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule DESC) AS place
        FROM parsed, split_rules
        WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)),
    found AS (
        SELECT p.page_id, host, path, rule, verdict AS ruled
        FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND place = 1),
    seeds AS (
        SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed,
               avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked
        FROM found WHERE host != '' GROUP BY host),
    linked AS (
        SELECT host AS src, unnest(regexp_extract_all(html, {quoted(url_trust.LINK)}, 1)) AS dst FROM parsed),
    edges AS (
        SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM (
            SELECT src, translate(dst, '{url_trust.UPPER}', '{url_trust.LOWER}') AS dst, count(*) AS n
            FROM linked WHERE src != '' AND dst != '' AND src != translate(dst, '{url_trust.UPPER}', '{url_trust.LOWER}')
            GROUP BY 1, 2)),
    flows AS MATERIALIZED (
        SELECT 'trust' AS kind, src AS source, dst AS host, share FROM edges UNION ALL
        SELECT 'distrust', dst, src, share FROM edges),
    r0 AS MATERIALIZED (
        SELECT * FROM (
            SELECT 'trust' AS kind, host, {1 - url_trust.DAMPING!r} * allowed AS value FROM seeds UNION ALL
            SELECT 'distrust', host, {1 - url_trust.DAMPING!r} * blocked FROM seeds) WHERE value > 0){steps},
    ranks AS (
        SELECT host, coalesce(sum(value) FILTER (kind = 'trust'), 0) AS trust,
               coalesce(sum(value) FILTER (kind = 'distrust'), 0) AS distrust
        FROM r{_STEPS} GROUP BY host)
    SELECT page_id, f.host, path, rule,
           CASE WHEN ruled IS NOT NULL THEN ruled
                WHEN distrust >= {url_trust.LEAST_DISTRUST!r} AND distrust > trust THEN 'block' ELSE 'allow' END AS verdict
    FROM found f LEFT JOIN ranks r ON r.host = f.host"""


def _canonical(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), {quoted(licence_digest.COPYRIGHT_LINE)}, ' ', 'g')"
    shown = f"' ' || regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for variant, spelling in licence_digest.SPELLINGS.items():
        shown = f"replace({shown}, ' {variant} ', ' {spelling} ')"
    return f"trim(regexp_replace({shown}, ' +', ' ', 'g'))"


def _licence_digest() -> str:
    texts = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in LICENCES.items())
    return f"""
    WITH known(name, text) AS (VALUES {texts}),
    names AS (
        SELECT sha256({_canonical("text")}) AS unit, min(name) AS name FROM known GROUP BY 1),
    whole AS (SELECT doc_id, text, sha256({_canonical("text")}) AS digest FROM documents),
    lines AS (SELECT doc_id, digest, unnest(string_split(text, chr(10))) AS line FROM whole),
    units AS (
        SELECT doc_id, digest, digest AS unit FROM whole UNION
        SELECT doc_id, digest, sha256({_canonical("line")}) FROM lines)
    SELECT doc_id, digest, max(name) FILTER (units.unit = digest) AS licence,
           coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), ';'), '') AS notices
    FROM units LEFT JOIN names USING (unit) GROUP BY doc_id, digest"""


ORACLES["op4_url_trust"] = _url_trust()
ORACLES["op5_licence_digest"] = _licence_digest()

# Words are separated by ASCII blanks; windows are compared as lists of words.
ORACLES["op11_substring_dedup"] = r"""
    WITH texts AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    windows AS (
        SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS name
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)),
    least AS (SELECT name, min(doc_id) AS doc_id FROM windows GROUP BY name),
    starts AS (
        SELECT w.doc_id, w.i FROM windows w JOIN least l ON l.name = w.name WHERE l.doc_id < w.doc_id),
    places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM texts),
    -- A word goes if one of the 50 windows that cover it does.
    judged AS (
        SELECT p.doc_id, p.i, p.word, max(s.i) OVER (
            PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) > p.i - 50 AS gone
        FROM places p LEFT JOIN starts s ON s.doc_id = p.doc_id AND s.i = p.i),
    kept AS (
        SELECT doc_id, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone IS NOT TRUE), '') AS text
        FROM judged GROUP BY doc_id)
    SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
           sha256(coalesce(k.text, '')) AS kept_sha256
    FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""

_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLES["op12_lexical_search"] = f"""
    WITH found AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
    sizes AS (SELECT doc_id, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
    corpus AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM sizes),
    asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    counts AS (
        SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM found)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM counts, corpus GROUP BY term),
    impacts AS (
        SELECT c.doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l)) AS impact
        FROM counts c JOIN sizes USING (doc_id), corpus),
    scores AS (
        SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 10"""
