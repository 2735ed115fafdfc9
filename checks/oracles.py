"""The SQL that DuckDB runs on the same tables to check the queries."""

from __future__ import annotations

from termeval.functions.text import STOP_WORDS, WHITESPACE

VIEWS = {
    "concept": """
        SELECT CAST(p_partkey * 8 AS BIGINT) AS concept_id, p_name AS concept_name,
               p_brand AS vocabulary_id, p_type AS concept_code,
               CASE WHEN p_size % 5 <> 0 THEN 'S' END AS standard_concept FROM part
        UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 8 + 1, r_name, 'Region',
               CAST(r_regionkey AS VARCHAR), 'S' FROM region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, n_name, 'Nation',
               CAST(n_nationkey AS VARCHAR), 'S' FROM nation
        UNION ALL SELECT c_custkey * 8 + 3, c_name, 'Customer', c_mktsegment, NULL FROM customer
        UNION ALL SELECT s_suppkey * 8 + 4, s_name, 'Supplier',
               CAST(s_nationkey AS VARCHAR), 'S' FROM supplier""",
    "concept_synonym": """
        SELECT CAST(p_partkey * 8 AS BIGINT) AS concept_id,
               concat(lower(p_type), ' ', p_name) AS concept_synonym_name FROM part
        UNION ALL SELECT p_partkey * 8, concat(p_name, ' ', lower(p_brand))
        FROM part WHERE p_size > 25""",
    "concept_relationship": """
        SELECT l_partkey * 8 AS concept_id_1, l_suppkey * 8 + 4 AS concept_id_2 FROM lineitem
        UNION ALL SELECT l_suppkey * 8 + 4, l_partkey * 8 FROM lineitem""",
    "concept_ancestor": """
        SELECT CAST(n_regionkey AS BIGINT) * 8 + 1 AS ancestor_id,
               CAST(n_nationkey AS BIGINT) * 8 + 2 AS descendant_id,
               1 AS min_levels, 1 AS max_levels FROM nation
        UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 8 + 2, c_custkey * 8 + 3, 1, 1 FROM customer
        UNION ALL SELECT CAST(s_nationkey AS BIGINT) * 8 + 2, s_suppkey * 8 + 4, 1, 1 FROM supplier
        UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 8 + 1, c_custkey * 8 + 3, 2, 2 + c_custkey % 2
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 8 + 1, s_suppkey * 8 + 4, 2, 2
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT concept_id, concept_id, 0, 0 FROM concept WHERE concept_id % 8 > 0""",
    "vectors": """
        SELECT concept_id, concept_name, vec_id, CAST(embedding AS DOUBLE[]) AS v
        FROM embeddings JOIN concept ON concept_id = vec_id * 8""",
    "name_vectors": """
        SELECT text, list(x ORDER BY pos) AS vector FROM (
            SELECT text, pos, round(avg(x), 9) AS x FROM (
                SELECT lower(concept_name) AS text, unnest(v) AS x,
                       generate_subscripts(v, 1) AS pos FROM vectors)
            GROUP BY text, pos)
        GROUP BY text""",
    "ranked": """
        SELECT row_id, text, concept_name, concept_id, score,
               row_number() OVER (PARTITION BY row_id ORDER BY round(score, 12), concept_id) AS rank
        FROM (SELECT q.concept_id AS row_id, lower(q.concept_name) AS text, c.concept_name, c.concept_id,
                     1 - list_cosine_similarity(c.v, q.v) AS score
              FROM vectors q CROSS JOIN vectors c)""",
    "name_seeds": "SELECT DISTINCT lower(concept_name) AS query_id FROM concept",
    "found_ids": """
        SELECT query_id, concept_id FROM name_seeds JOIN concept ON lower(concept_name) = query_id""",
    "eval_pairs": """
        SELECT a.p_partkey AS row_id, b.p_name AS input_data, a.p_name AS expected_output,
               CASE a.p_partkey % 4 WHEN 0 THEN concat(' ', upper(a.p_name))
                    WHEN 1 THEN a.p_name ELSE b.p_name END AS prediction
        FROM part a JOIN part b
          ON b.p_partkey = (a.p_partkey * 7 + 3) % (SELECT count(*) FROM part)""",
    "eval_related": """
        SELECT row_id, expected_output,
               CASE WHEN row_id % 4 > 1 THEN concat(upper(s_name), chr(9)) ELSE prediction END AS prediction
        FROM eval_pairs JOIN supplier
          ON s_suppkey = (row_id * 7 + 3) % (SELECT count(*) FROM supplier)""",
    "eval_hierarchy": """
        SELECT c_custkey AS row_id, c_name AS expected_output,
               CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN lower(r_name)
                    ELSE concat(' Nation_', CAST(c_custkey % 25 AS VARCHAR)) END AS prediction
        FROM customer JOIN region ON r_regionkey = c_custkey % 5""",
    "order_items": """
        SELECT l_orderkey AS row_id, p_name AS item, l_quantity, l_returnflag
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "order_scores": """
        SELECT o_orderkey AS row_id, hits / nullif(predicted, 0) AS p, hits / nullif(relevant, 0) AS r
        FROM orders
        JOIN (SELECT o_orderkey AS k, CAST(count(item) AS DOUBLE) AS predicted
              FROM orders LEFT JOIN (SELECT * FROM order_items WHERE l_quantity > 20)
                ON row_id = o_orderkey GROUP BY o_orderkey) a ON a.k = o_orderkey
        JOIN (SELECT o_orderkey AS k, CAST(count(DISTINCT item) AS DOUBLE) AS relevant
              FROM orders LEFT JOIN (SELECT * FROM order_items WHERE l_returnflag <> 'R')
                ON row_id = o_orderkey GROUP BY o_orderkey) b ON b.k = o_orderkey
        JOIN (SELECT o_orderkey AS k, CAST(count(item) AS DOUBLE) AS hits
              FROM orders LEFT JOIN (
                SELECT row_id, item FROM order_items WHERE l_quantity > 20 AND (row_id, item) IN (
                    SELECT (row_id, item) FROM order_items WHERE l_returnflag <> 'R'))
                ON row_id = o_orderkey GROUP BY o_orderkey) c ON c.k = o_orderkey""",
    "searches": "SELECT DISTINCT p_name AS query_id, concat('the ', p_name) AS search_term FROM part",
    "standard": """
        SELECT concept_id, concept_name, vocabulary_id, concept_code
        FROM concept WHERE standard_concept = 'S'""",
    "branded": "SELECT * FROM standard WHERE vocabulary_id IN ('Brand#13', 'Brand#5')",
    "replies": "SELECT input_data, min(prediction) AS reply FROM eval_pairs GROUP BY input_data",
    "answers": """
        SELECT 'identity' AS pipeline, row_id, input_data AS prediction, expected_output FROM eval_pairs
        UNION ALL SELECT 'replay', row_id, reply, expected_output
        FROM eval_pairs JOIN replies USING (input_data)""",
}

USES = {
    "concept_ancestor": ["concept"],
    "vectors": ["concept"],
    "name_vectors": ["vectors"],
    "ranked": ["vectors"],
    "name_seeds": ["concept"],
    "found_ids": ["name_seeds"],
    "eval_related": ["eval_pairs"],
    "order_scores": ["order_items"],
    "standard": ["concept"],
    "branded": ["standard"],
    "replies": ["eval_pairs"],
    "answers": ["replies"],
}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` over the named views and those they use, plus ``more`` of its own."""
    named: dict[str, str] = {}

    def add(name):
        for used in USES.get(name, ()):
            add(used)
        named.setdefault(name, VIEWS[name])

    for view in views:
        add(view)
    parts = [f"{name} AS ({text})" for name, text in {**named, **more}.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


STOPS = "['', " + ", ".join(f"'{word}'" for word in STOP_WORDS) + "]"
SPACES = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)


def normal(column: str) -> str:
    return f"lower(trim({column}, {SPACES}))"


def words(column: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array(lower({column}), "
        rf"'[^\p{{L}}\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w)))"
    )


def ratios(pairs: str) -> dict[str, str]:
    """Views that end in ``ratios (a, b, ratio)`` for the texts of ``pairs (x, y)``.

    The longest common subsequence is the textbook table, one row per letter.
    """
    return {
        "texts": f"SELECT DISTINCT lower(x) AS a, lower(y) AS b FROM ({pairs})",
        "ratios": """
            SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 100.0
                   ELSE 100 * (1 - (len(a) + len(b) - 2 * lcs) / (len(a) + len(b))) END AS ratio
            FROM (SELECT a, b, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_last(list_reduce(
                list_prepend(list_transform(range(len(b) + 1), lambda z: 0),
                             list_transform(range(len(a)), lambda i: [i])),
                lambda above, i: list_reduce(
                    list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [j])),
                    lambda row, j: list_append(row,
                        CASE WHEN substr(b, j[1], 1) = substr(a, i[1] + 1, 1) THEN above[j[1]] + 1
                             ELSE greatest(above[j[1] + 1], row[j[1]]) END)))) END AS lcs
            FROM texts)""",
    }


ORACLES: dict[str, str] = {}

ORACLES["exact_match"] = sql(
    "SELECT row_id, CAST(prediction = expected_output AS INT) AS score FROM eval_pairs", "eval_pairs"
)
ORACLES["exact_match_numbers"] = (
    "SELECT l_orderkey * 16 + l_linenumber AS row_id, "
    "CAST(l_tax <> 0 AND CAST(l_tax AS DOUBLE) = CAST(l_discount AS DOUBLE) AS INT) AS score FROM lineitem"
)
ORACLES["uncased_match"] = sql(
    f"SELECT row_id, CAST({normal('prediction')} = {normal('expected_output')} AS DOUBLE) AS score "
    "FROM eval_pairs",
    "eval_pairs",
)
ORACLES["fuzzy_match_ratio"] = sql(
    "SELECT row_id, round(ratio, 6) AS score FROM eval_pairs "
    "JOIN ratios ON a = lower(prediction) AND b = lower(expected_output)",
    "eval_pairs",
    **ratios("SELECT prediction AS x, expected_output AS y FROM eval_pairs"),
)
_TOLD = """
    SELECT s_suppkey AS k, concat(s_name, ' delivers all goods from ', n_name, ', ', r_name, ' to buyers outside ',
                                  upper(n_name), '. ', n_name, ', ', r_name) AS told
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_DESCRIPTIONS = f"""
    SELECT a.k AS row_id, b.told AS prediction, a.told AS expected_output FROM ({_TOLD}) a JOIN ({_TOLD}) b
    ON a.k = (b.k + 1) % (SELECT count(*) FROM supplier)"""
ORACLES["fuzzy_match_long"] = sql(
    "SELECT row_id, round(ratio, 6) AS score FROM descriptions "
    "JOIN ratios ON a = lower(prediction) AND b = lower(expected_output)",
    descriptions=_DESCRIPTIONS,
    **ratios("SELECT prediction AS x, expected_output AS y FROM descriptions"),
)
_SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
ORACLES["python_metric"] = sql(
    "SELECT row_id, CASE WHEN row_id % 7 <> 0 THEN round(len(list_intersect(p, a)) / "
    "len(list_distinct(list_concat(p, a))), 6) END AS score FROM ("
    f"SELECT row_id, {_SPLIT.format('prediction')} AS p, {_SPLIT.format('expected_output')} AS a FROM eval_pairs)",
    "eval_pairs",
)
for _name, _function in (("dot", "inner_product"), ("cosine", "cosine_similarity")):
    ORACLES[f"{_name}_similarity"] = sql(
        f"SELECT concept_id AS row_id, round(list_{_function}(v, vector), 4) AS score "
        "FROM vectors JOIN name_vectors ON text = lower(concept_name)",
        "name_vectors",
    )

ORACLES["ids_matching_name"] = sql("SELECT * FROM found_ids", "found_ids")
ORACLES["ids_matching_name_in_vocabularies"] = sql(
    "SELECT query_id, concept_id FROM name_seeds JOIN concept ON lower(concept_name) = query_id "
    "WHERE vocabulary_id IN ('Brand#13', 'Brand#5')",
    "name_seeds",
)


def _linked(ids: str, edges: str, near: str, far: str, bounds: str = "true") -> str:
    return (
        f"SELECT query_id, c.* FROM {ids} s JOIN {edges} e ON e.{near} = s.concept_id "
        f"JOIN concept c ON c.concept_id = e.{far} WHERE {bounds}"
    )


_UP, _DOWN = ("descendant_id", "ancestor_id"), ("ancestor_id", "descendant_id")
_ALONG = ("concept_id_1", "concept_id_2")
ORACLES["ancestors_by_name"] = sql(
    _linked("found_ids", "concept_ancestor", *_UP), "found_ids", "concept_ancestor"
)
ORACLES["ancestors_by_name_bounded"] = sql(
    _linked("found_ids", "concept_ancestor", *_UP, "min_levels >= 1 AND max_levels <= 2"),
    "found_ids", "concept_ancestor",
)
ORACLES["descendants_by_name"] = sql(
    _linked("found_ids", "concept_ancestor", *_DOWN), "found_ids", "concept_ancestor"
)
ORACLES["descendants_by_name_bounded"] = sql(
    _linked("found_ids", "concept_ancestor", *_DOWN, "min_levels >= 0 AND max_levels <= 1"),
    "found_ids", "concept_ancestor",
)
ORACLES["related_by_name"] = sql(
    _linked("found_ids", "concept_relationship", *_ALONG), "found_ids", "concept_relationship"
)
ORACLES["related_by_name_in_vocabularies"] = sql(
    _linked(
        "(SELECT f.* FROM found_ids f JOIN concept USING (concept_id) "
        "WHERE vocabulary_id IN ('Brand#13', 'Brand#5'))",
        "concept_relationship", *_ALONG,
    ),
    "found_ids", "concept_relationship",
)
_SELF = "(SELECT concept_id AS query_id, concept_id FROM concept)"
ORACLES["ancestors_by_id"] = sql(_linked(_SELF, "concept_ancestor", *_UP), "concept_ancestor")
ORACLES["related_by_id"] = sql(
    _linked(_SELF, "concept_relationship", *_ALONG), "concept", "concept_relationship"
)
ORACLES["all_vocabularies"] = sql("SELECT DISTINCT vocabulary_id FROM concept", "concept")

_MEANS = """
    SELECT {key} AS k, list(x ORDER BY pos) AS q FROM (
        SELECT {key}, pos, round(avg(x), 9) AS x FROM (
            SELECT {key}, CAST(unnest(embedding) AS DOUBLE) AS x,
                   generate_subscripts(embedding, 1) AS pos FROM {source})
        GROUP BY {key}, pos) GROUP BY {key}"""
ORACLES["vector_topk"] = sql(
    "SELECT concept_id, concept_name AS content, round(score, 4) AS score FROM ("
    "SELECT concept_id, concept_name, 1 - list_cosine_similarity(v, q) AS score "
    "FROM means CROSS JOIN vectors) ORDER BY round(score, 12), concept_id LIMIT 5",
    "vectors",
    everything="SELECT 0 AS everything, embedding FROM embeddings",
    means=_MEANS.format(key="everything", source="everything"),
)
ORACLES["vector_topk_batch"] = sql(
    "SELECT query_id, CAST(rank AS INT) AS rank, concept_id, content, round(score, 4) AS score FROM ("
    "SELECT k AS query_id, concept_id, concept_name AS content, score, row_number() OVER ("
    "PARTITION BY k ORDER BY round(score, 12), concept_id) AS rank FROM ("
    "SELECT k, concept_id, concept_name, 1 - list_cosine_similarity(v, q) AS score "
    "FROM means CROSS JOIN vectors)) WHERE rank <= 10",
    "vectors",
    means=_MEANS.format(key="label", source="embeddings"),
)

ORACLES["vector_self_topk"] = sql(
    "SELECT query_id, CAST(rank AS INT) AS rank, concept_id, content, round(score, 4) AS score FROM ("
    "SELECT query_id, concept_id, content, score, row_number() OVER ("
    "PARTITION BY query_id ORDER BY round(score, 12), concept_id) AS rank FROM ("
    "SELECT q.concept_id AS query_id, c.concept_id, c.concept_name AS content, "
    "1 - list_cosine_similarity(c.v, q.v) AS score "
    "FROM vectors AS q JOIN vectors AS c ON q.concept_id <> c.concept_id)) WHERE rank <= 5",
    "vectors",
)

_SELF_TOP = "SELECT query_id, rank, concept_id, score FROM ({})".format(ORACLES["vector_self_topk"])
for _name in ("vector_grid_topk", "vector_index_every_cell"):
    ORACLES[_name] = _SELF_TOP

ORACLES["search_term_preprocess"] = (
    "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), "
    rf"'[\s\x0b\p{{Z}}]+'), lambda w: NOT list_contains({STOPS}, w)), ' | ') AS search_term FROM documents"
)


def _search(source: str, mode: str, synonyms: bool) -> str:
    hit = "list_has_any(words, terms)" if mode == "any" else "list_has_all(words, terms)"
    columns = "query_id, s.concept_id, concept_name, vocabulary_id, concept_code"
    views = {
        "terms": f"SELECT query_id, {words('search_term')} AS terms FROM searches",
        "names": f"SELECT *, {words('concept_name')} AS words FROM {source}",
        "synonyms": f"SELECT concept_id, concept_synonym_name, {words('concept_synonym_name')} AS words "
        f"FROM concept_synonym WHERE concept_id IN (SELECT concept_id FROM {source})",
        "synonym_hits": "SELECT query_id, concept_id, concept_synonym_name FROM terms "
        f"JOIN synonyms ON {hit}",
    }
    if not synonyms:
        body = (
            f"SELECT {columns}, CAST(NULL AS VARCHAR) AS concept_synonym_name "
            f"FROM terms JOIN names s ON {hit}"
        )
        return sql(body, "searches", source, terms=views["terms"], names=views["names"])
    body = (
        f"SELECT t.{columns}, concept_synonym_name FROM terms t CROSS JOIN names s "
        "LEFT JOIN synonym_hits h ON h.query_id = t.query_id AND h.concept_id = s.concept_id "
        f"WHERE {hit} OR h.concept_id IS NOT NULL"
    )
    return sql(body, "searches", source, "concept_synonym", **views)


ORACLES["text_search"] = _search("standard", "any", False)
ORACLES["text_search_all_terms"] = _search("branded", "all", False)
ORACLES["text_search_synonyms"] = _search("standard", "any", True)
ORACLES["text_search_synonyms_all_terms"] = _search("branded", "all", True)

ORACLES["text_search_indexed"] = ORACLES["text_search"]
_CLAUSES = {
    "clauses": "SELECT DISTINCT concat(p_name, ' ', lower(p_type)) AS query_id, "
    "[string_split(p_name, ' ')[1], lower(p_type)] AS one, [string_split(p_name, ' ')[-1], 'bolt'] AS other FROM part"
}
_MEETS = "list_has_any(words, one) AND list_has_any(words, other)"
ORACLES["text_search_clauses"] = sql(
    "SELECT query_id, s.concept_id, concept_name, vocabulary_id, concept_code, "
    f"CAST(NULL AS VARCHAR) AS concept_synonym_name FROM clauses JOIN names s ON {_MEETS}",
    "standard", **_CLAUSES, names=f"SELECT *, {words('concept_name')} AS words FROM standard",
)
ORACLES["text_search_indexed_clauses"] = sql(
    "SELECT c.query_id, s.concept_id, concept_name, vocabulary_id, concept_code, concept_synonym_name "
    "FROM clauses c CROSS JOIN names s LEFT JOIN synonym_hits h "
    f"ON h.query_id = c.query_id AND h.concept_id = s.concept_id WHERE ({_MEETS}) OR h.concept_id IS NOT NULL",
    "branded", "concept_synonym", **_CLAUSES,
    names=f"SELECT *, {words('concept_name')} AS words FROM branded",
    synonyms=f"SELECT concept_id, concept_synonym_name, {words('concept_synonym_name')} AS words "
    "FROM concept_synonym WHERE concept_id IN (SELECT concept_id FROM branded)",
    synonym_hits=f"SELECT query_id, concept_id, concept_synonym_name FROM clauses JOIN synonyms ON {_MEETS}",
)

_RELATED = (
    "SELECT DISTINCT lower(a.concept_name) AS seed, lower(b.concept_name) AS target "
    "FROM concept_relationship JOIN concept a ON a.concept_id = concept_id_1 "
    "JOIN concept b ON b.concept_id = concept_id_2"
)
_MATCH = (
    "SELECT row_id, CAST({same} OR (lower(expected_output), {sought}) IN "
    "(SELECT (seed, target) FROM near) AS DOUBLE) AS score FROM {rows}"
)
_NORMAL = f"{normal('prediction')} = {normal('expected_output')}"
for _suffix, _where in (
    ("", ""),
    ("_in_vocabularies", " WHERE a.vocabulary_id IN ('Brand#13', 'Brand#5')"),
):
    ORACLES[f"related_name_match{_suffix}"] = sql(
        _MATCH.format(same=_NORMAL, sought=normal("prediction"), rows="eval_related"),
        "eval_related", "concept", "concept_relationship", near=_RELATED + _where,
    )
_ABOVE = (
    "SELECT DISTINCT {seed} AS seed, {target} AS target FROM concept_ancestor "
    "JOIN concept a ON a.concept_id = descendant_id JOIN concept b ON b.concept_id = ancestor_id "
    "WHERE {bounds}"
)
_ABOVE_LOWER = _ABOVE.format(
    seed="lower(a.concept_name)",
    target="lower(b.concept_name)",
    bounds="min_levels >= 1 AND max_levels <= 2",
)
ORACLES["ancestor_name_match"] = sql(
    _MATCH.format(same=_NORMAL, sought=normal("prediction"), rows="eval_hierarchy"),
    "eval_hierarchy", "concept_ancestor", near=_ABOVE_LOWER,
)
ORACLES["ancestor_name_match_raw"] = sql(
    _MATCH.format(
        same="lower(prediction) = lower(expected_output)", sought="prediction", rows="eval_hierarchy"
    ),
    "eval_hierarchy", "concept_ancestor", near=_ABOVE_LOWER,
)
ORACLES["related_name_precision"] = sql(
    "SELECT o_orderkey AS row_id, round(avg(hit), 6) AS score FROM orders LEFT JOIN ("
    "SELECT l_orderkey, CAST((lower(p_name), s_name) IN (SELECT (seed, target) FROM near) AS DOUBLE) AS hit "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN part ON p_partkey = l_orderkey % (SELECT count(*) FROM part)) ON l_orderkey = o_orderkey "
    "GROUP BY o_orderkey",
    "concept",
    "concept_relationship",
    near=_RELATED.replace("lower(b.concept_name)", "b.concept_name")
    + " WHERE a.vocabulary_id IN ('Brand#13', 'Brand#5')",
)
ORACLES["ancestor_name_precision"] = sql(
    "SELECT c_custkey AS row_id, round(avg(hit), 6) AS score FROM ("
    "SELECT c_custkey, CAST((lower(c_name), item) IN (SELECT (seed, target) FROM near) AS DOUBLE) AS hit FROM ("
    "SELECT c_custkey, c_name, unnest([n_name, n_name, r_name, lower(n_name)]) AS item FROM customer "
    "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = c_custkey % 5)) GROUP BY c_custkey",
    "concept_ancestor",
    near=_ABOVE.format(
        seed="lower(a.concept_name)", target="b.concept_name", bounds="min_levels >= 1"
    ),
)

ORACLES["precision"] = sql("SELECT row_id, round(p, 6) AS score FROM order_scores", "order_scores")
ORACLES["recall"] = sql("SELECT row_id, round(r, 6) AS score FROM order_scores", "order_scores")
ORACLES["fscore"] = sql(
    "SELECT row_id, round(5 * p * r / nullif(4 * p + r, 0), 6) AS score FROM order_scores",
    "order_scores",
)

_HEAD = "'Give the formal name of the item. Answer with the name only.' || chr(10) || chr(10) || "
_TAIL = " || chr(10) || 'Response:' AS prompt"
ORACLES["prompt_llm"] = (
    f"SELECT p_partkey AS row_id, {_HEAD} 'Informal name: ' || lower(p_type) || ' ' || p_name "
    f"|| '<|eot_id|>' {_TAIL} FROM part"
)
ORACLES["eot_prompt"] = (
    f"SELECT p_partkey AS row_id, {_HEAD} 'Informal name: ' || p_name || "
    f"CASE WHEN p_type = 'ECONOMY' THEN '<|eot_id|>' ELSE '' END {_TAIL} FROM part"
)
for _name, _score in (
    ("prompt_rag", ""),
    ("prompt_rag_scores", " || ' (cosine distance = ' || CAST(CAST(round(score, 4) AS DECIMAL(18, 4)) AS VARCHAR) || ')'"),
):
    ORACLES[_name] = sql(
        f"SELECT row_id, {_HEAD} 'Possible related terms:' || chr(10) || "
        f"string_agg('    ' || concept_name{_score}, chr(10) ORDER BY rank) || chr(10) || chr(10) || "
        f"'Informal name: ' || text || '<|eot_id|>' {_TAIL} FROM ranked WHERE rank <= 5 GROUP BY row_id, text",
        "ranked",
    )

_TEXTS = ratios("SELECT prediction AS x, expected_output AS y FROM answers")
_LONG = {
    **_TEXTS,
    "scores": f"""
        SELECT pipeline, row_id, 'ExactMatch' AS metric,
               CAST(prediction = expected_output AS DOUBLE) AS value FROM answers
        UNION ALL SELECT pipeline, row_id, 'UncasedMatch', CAST({_NORMAL} AS DOUBLE) FROM answers
        UNION ALL SELECT pipeline, row_id, 'FuzzyMatchRatio', ratio FROM answers
        JOIN ratios ON a = lower(prediction) AND b = lower(expected_output)""",
}
_ROUNDED = "SELECT pipeline, row_id, metric, round(value, 4) AS value FROM scores"
ORACLES["evaluation_long"] = sql(_ROUNDED, "answers", **_LONG)
for _name in ("identity", "replay"):
    ORACLES[f"{_name}_eval"] = sql(f"{_ROUNDED} WHERE pipeline = '{_name}'", "answers", **_LONG)
ORACLES["evaluation_summary"] = sql(
    "SELECT pipeline, metric, round(avg(value), 4) AS mean_value, count(*) AS n_rows, "
    "count(*) - count(value) AS n_undefined, CASE metric "
    "WHEN 'ExactMatch' THEN 'Exact match: prediction and expected output are the same' "
    "WHEN 'UncasedMatch' THEN 'Uncased match: equal when case and surrounding whitespace are ignored' "
    "ELSE 'Fuzzy match: normalized indel similarity, 0 to 100, ignoring case' END AS metric_description "
    "FROM scores GROUP BY pipeline, metric",
    "answers", **_LONG,
)
ORACLES["evaluation_compare"] = sql(
    "SELECT pipeline, "
    + ", ".join(
        f"round(avg(value) FILTER (metric = '{m}'), 4) AS {m}"
        for m in ("ExactMatch", "UncasedMatch", "FuzzyMatchRatio")
    )
    + " FROM scores GROUP BY pipeline",
    "answers", **_LONG,
)
ORACLES["embedding_eval"] = sql(
    " UNION ALL ".join(
        f"SELECT 'embedding' AS pipeline, row_id, '{metric}VectorSimilarity' AS metric, "
        f"round(list_{function}(a.vector, b.vector), 4) AS value FROM eval_pairs "
        "LEFT JOIN name_vectors a ON a.text = input_data LEFT JOIN name_vectors b ON b.text = expected_output"
        for metric, function in (("Dot", "inner_product"), ("Cosine", "cosine_similarity"))
    ),
    "eval_pairs", "name_vectors",
)

_COUNTS = "[{}]".format(
    ", ".join(f"CAST(len({{0}}) - len(replace({{0}}, '{letter}', '')) AS DOUBLE)" for letter in "abcdefgh")
)
ORACLES["encoder_eval"] = sql(
    " UNION ALL ".join(
        f"SELECT 'encoder' AS pipeline, row_id, '{metric}VectorSimilarity' AS metric, "
        f"round(list_{function}(p, a), 4) AS value FROM counted"
        for metric, function in (("Dot", "inner_product"), ("Cosine", "cosine_similarity"))
    ),
    "eval_pairs",
    counted=f"SELECT row_id, {_COUNTS.format('input_data')} AS p, {_COUNTS.format('expected_output')} AS a FROM eval_pairs",
)

_LISTS = {
    "depths": "SELECT unnest([5, 10, 20]) AS k",
    "lists": """
        SELECT k, row_id, text, min_by(concept_name, rank) AS first,
               CAST(count(*) AS DOUBLE) AS n,
               CAST(count(*) FILTER (concept_name = text) AS DOUBLE) AS hits
        FROM ranked JOIN depths ON rank <= k GROUP BY k, row_id, text""",
}
ORACLES["rag_eval"] = sql(
    "SELECT 'top ' || k AS pipeline, row_id, metric, round(value, 4) AS value FROM ("
    "SELECT k, row_id, 'UncasedMatch' AS metric, CAST(lower(first) = text AS DOUBLE) AS value FROM lists "
    "UNION ALL SELECT k, row_id, 'FuzzyMatchRatio', ratio FROM lists JOIN ratios ON a = lower(first) AND b = text "
    "UNION ALL SELECT k, row_id, 'PrecisionMetric', hits / n FROM lists "
    "UNION ALL SELECT k, row_id, 'RecallMetric', hits FROM lists "
    "UNION ALL SELECT k, row_id, 'FScoreMetric', 5 * (hits / n) * hits / nullif(4 * hits / n + hits, 0) FROM lists)",
    "ranked", **_LISTS, **ratios("SELECT first AS x, text AS y FROM lists"),
)
ORACLES["retrieval_naming"] = sql(
    "SELECT 'nearest name' AS pipeline, metric, round(avg(value), 6) AS mean_value, count(*) AS n_rows, "
    "count(*) - count(value) AS n_undefined FROM ("
    "SELECT 'UncasedMatch' AS metric, CAST(lower(first) = text AS DOUBLE) AS value FROM lists WHERE k = 5 "
    "UNION ALL SELECT 'PrecisionMetric', hits / n FROM lists WHERE k = 5) GROUP BY metric",
    "ranked", **_LISTS,
)

_FOUND = {
    "terms": f"SELECT query_id, search_term, {words('search_term')} AS terms FROM searches",
    "names": f"SELECT *, {words('concept_name')} AS words FROM standard",
}
ORACLES["concept_lookup"] = sql(
    "SELECT query_id, search_term, concept_name, concept_id, vocabulary_id, concept_code, "
    "round(ratio, 6) AS concept_name_similarity_score FROM found "
    "JOIN ratios ON a = lower(search_term) AND b = lower(concept_name)",
    "searches", "standard", **_FOUND,
    found="SELECT * FROM terms JOIN names ON list_has_any(words, terms)",
    **ratios("SELECT search_term AS x, concept_name AS y FROM found"),
)
ORACLES["concept_lookup_links"] = sql(
    "SELECT query_id, concept_id, 'CONCEPT_SYNONYM' AS section, CAST(NULL AS BIGINT) AS linked_id, "
    "concept_synonym_name AS linked_name FROM found JOIN concept_synonym USING (concept_id) "
    "UNION ALL SELECT query_id, f.concept_id, 'CONCEPT_ANCESTOR', c.concept_id, c.concept_name FROM found f "
    "JOIN concept_ancestor ON descendant_id = f.concept_id JOIN concept c ON c.concept_id = ancestor_id "
    "UNION ALL SELECT query_id, f.concept_id, 'CONCEPT_RELATIONSHIP', c.concept_id, c.concept_name FROM found f "
    "JOIN concept_relationship ON concept_id_1 = f.concept_id JOIN concept c ON c.concept_id = concept_id_2",
    "searches", "standard", "concept_synonym", "concept_ancestor", "concept_relationship", **_FOUND,
    found="SELECT query_id, concept_id FROM terms JOIN names ON list_has_all(words, terms)",
)

# The links of the best concepts, each section cut to its first four entries.
_SECTIONS = {
    "concept_synonym": "SELECT concept_id, CAST(NULL AS BIGINT) AS linked_id, concept_synonym_name AS linked_name FROM concept_synonym",
    "concept_ancestor": "SELECT descendant_id AS concept_id, c.concept_id AS linked_id, c.concept_name AS linked_name "
    "FROM concept_ancestor JOIN concept c ON c.concept_id = ancestor_id",
    "concept_relationship": "SELECT concept_id_1 AS concept_id, c.concept_id AS linked_id, c.concept_name AS linked_name "
    "FROM concept_relationship JOIN concept c ON c.concept_id = concept_id_2",
}
_LINKS = ", ".join(
    f"coalesce(string_agg(coalesce({name}, ''), ';' ORDER BY rank) FILTER (rank IS NOT NULL), '') AS {name}" for name in _SECTIONS
)
ORACLES["concept_answers"] = sql(
    "SELECT s.query_id, s.search_term, "
    "coalesce(string_agg(CAST(b.concept_id AS VARCHAR), ';' ORDER BY rank), '') AS concept_ids, "
    f"coalesce(round(sum(score), 4), 0.0) AS score_sum, {_LINKS} "
    "FROM asked s LEFT JOIN best b ON b.query_id = s.query_id "
    + " ".join(f"LEFT JOIN cut_{name} ON cut_{name}.concept_id = b.concept_id" for name in _SECTIONS)
    + " GROUP BY s.query_id, s.search_term",
    "searches", "standard", "concept_synonym", "concept_ancestor", "concept_relationship",
    asked="SELECT * FROM searches UNION ALL SELECT DISTINCT p_type, concat('the ', lower(p_type)) FROM part",
    terms=f"SELECT query_id, search_term, {words('search_term')} AS terms FROM asked",
    names=_FOUND["names"],
    found="SELECT * FROM terms JOIN names ON list_has_any(words, terms)",
    **ratios("SELECT search_term AS x, concept_name AS y FROM found"),
    best="""
        SELECT query_id, concept_id, ratio AS score, row_number() OVER (
            PARTITION BY query_id ORDER BY ratio DESC, concept_id) AS rank
        FROM found JOIN ratios ON a = lower(search_term) AND b = lower(concept_name) QUALIFY rank <= 5""",
    **{
        f"cut_{name}": f"""
        SELECT concept_id, string_agg(linked_name, ',' ORDER BY place) AS {name} FROM (
            SELECT concept_id, linked_name, row_number() OVER (
                PARTITION BY concept_id ORDER BY linked_name, linked_id NULLS FIRST) AS place
            FROM (SELECT DISTINCT * FROM ({body})) WHERE concept_id IN (SELECT concept_id FROM best))
        WHERE place <= 4 GROUP BY concept_id"""
        for name, body in _SECTIONS.items()
    },
)
