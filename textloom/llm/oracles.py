"""SQL of the problems' queries that SQL can say, written from the statement of each problem and not from the operators.

Similarity joins use the prefix rule: two sets that share 0.8 of their union share one of the rarest fifth of either, so a
join on those finds every pair; each is then counted out exactly.
"""

from __future__ import annotations

from textloom.plans.pipelines import _SPACE, PIECE_COUNT

_TOKENS = rf"regexp_extract_all(code, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]')"


def _sets(rows: str) -> str:
    """``r(id, s)``: the set of five-token runs of each row of ``rows(id, code)``; a shorter text has one run of all."""
    runs = "CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))) END"
    return f"r AS MATERIALIZED (SELECT id, hash(unnest({runs})) AS s FROM (SELECT id, {_TOKENS} AS t FROM {rows}))"


#: ``like_(a, b)``, a < b: ids whose sets share at least 0.8 of their union.
_ALIKE = (
    "c AS (SELECT s, count(*) AS n FROM r GROUP BY s), z AS (SELECT id, count(*) AS size FROM r GROUP BY id), "
    "o AS (SELECT id, s, size, row_number() OVER (PARTITION BY id ORDER BY n, s) AS k FROM r JOIN c USING (s) JOIN z USING (id)), "
    "p AS (SELECT id, s, size FROM o WHERE k <= size - ceil(0.8 * size) + 1), "
    "q AS (SELECT DISTINCT x.id AS a, y.id AS b, x.size AS m, y.size AS n FROM p x JOIN p y ON x.s = y.s AND x.id < y.id WHERE least(x.size, y.size) >= 0.8 * greatest(x.size, y.size)), "
    "w AS (SELECT a, b, m, n, count(*) AS common FROM q JOIN r x ON x.id = a JOIN r y ON y.id = b AND y.s = x.s GROUP BY a, b, m, n), "
    "like_ AS (SELECT a, b FROM w WHERE common >= 0.8 * (m + n - common))"
)
_FILES = "(SELECT DISTINCT file_id AS id, code FROM code_files WHERE code <> '')"

P1_FOUND = f"WITH {_sets(_FILES)}, {_ALIKE} SELECT a AS file_id_a, b AS file_id_b FROM like_"
P1_LINKS = (
    f"WITH {_sets(_FILES)}, {_ALIKE}, h AS (SELECT min(id) AS id FROM (SELECT id, {_TOKENS} AS t FROM {_FILES}) GROUP BY t) "
    "SELECT a AS file_id_a, b AS file_id_b, round(common / (m + n - common), 6) AS similarity FROM w WHERE common >= 0.8 * (m + n - common) AND a IN (SELECT id FROM h) AND b IN (SELECT id FROM h)"
)
P1_GROUPS = (
    f"WITH RECURSIVE {_sets(_FILES)}, {_ALIKE}, e AS (SELECT a AS x, b AS y FROM like_ UNION ALL SELECT b, a FROM like_), "
    "g AS (SELECT DISTINCT file_id AS node, file_id AS least FROM code_files WHERE file_id IS NOT NULL UNION SELECT e.y, g.least FROM g JOIN e ON e.x = g.node WHERE g.least < e.y) "
    "SELECT node AS file_id, min(least) AS group_id FROM g GROUP BY node"
)
P1_MEMBERS = f"SELECT file_id, min(file_id) OVER (PARTITION BY t) AS same_as FROM (SELECT DISTINCT file_id, {_TOKENS} AS t FROM code_files WHERE code <> '')"

_CODE = "(SELECT file_id, code FROM code_files WHERE code <> '')"
P2_FOUND = (
    f"WITH t AS (SELECT file_id, max({PIECE_COUNT}) + 3 AS tokens FROM {_CODE} GROUP BY file_id) "
    "SELECT DISTINCT file_id FROM doc_index JOIN t USING (file_id) WHERE length IS NULL OR length <= 0 OR length * 2 < tokens OR length > tokens * 2"
)

_PROJECT = (
    r"nullif(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^([a-z][a-z0-9+.-]*://)?([^@/\s]*@)?(www\.)?forge\.example(:[0-9]+/)?[/:]*', ''), '(\.git|/|\s)+$', ''), '')"
)
_HOME = r"CASE WHEN regexp_matches(lower({0}), '^\s*([a-z][a-z0-9+.-]*://)?([^@/\s]*@)?(www\.)?forge\.example[/:]') THEN " + _PROJECT + r" ELSE nullif(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '(\.git|/|\s)+$', ''), '') END"
P3_FOUND = (
    f"WITH RECURSIVE s AS (SELECT DISTINCT repo, {_HOME.format('repo')} AS p FROM code_files WHERE repo IS NOT NULL), "
    f"l AS (SELECT DISTINCT {_HOME.format('repo')} AS x, {_HOME.format('other_repo')} AS y FROM repo_links WHERE lower(trim(relation)) IN ('rename', 'transfer', 'mirror', 'fork')), "
    "e AS (SELECT x, y FROM l WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT y, x FROM l WHERE x IS NOT NULL AND y IS NOT NULL), "
    "n AS (SELECT p FROM s WHERE p IS NOT NULL UNION SELECT x FROM e), g AS (SELECT p AS node, p AS least FROM n UNION SELECT e.y, g.least FROM g JOIN e ON e.x = g.node WHERE g.least < e.y), "
    "c AS (SELECT node, min(least) AS least FROM g GROUP BY node), d AS (SELECT repo, least FROM s JOIN c ON c.node = s.p) SELECT x.repo AS repo_a, y.repo AS repo_b FROM d x JOIN d y ON x.least = y.least AND x.repo < y.repo"
)

_CLASSED = "(SELECT file_id, min(framework || '|' || CASE WHEN lang = 'tsx' THEN 'tsx' ELSE 'other' END) AS class_key, min(strlen(code)) AS bytes FROM code_files WHERE framework IS NOT NULL AND lang IS NOT NULL AND code <> '' GROUP BY file_id)"
P6_FOUND = f"SELECT t.class_key FROM (SELECT DISTINCT class_key, target_share, target_bytes, max_repeats FROM mix_targets) t LEFT JOIN (SELECT class_key, sum(bytes) AS bytes FROM {_CLASSED} GROUP BY class_key) f USING (class_key) WHERE coalesce(bytes, 0) * max_repeats < target_share * target_bytes"

_ALL = "(SELECT DISTINCT file_id AS id, code FROM code_files WHERE code <> '' UNION ALL SELECT new_id, code FROM incoming_files WHERE code <> '')"
#: Rows of the batches in their order, each with the earlier ones and the files that it is like; one step of the walk for each.
P7_FOUND = (
    f"WITH RECURSIVE {_sets(_ALL)}, {_ALIKE}, i AS (SELECT new_id, row_number() OVER (ORDER BY batch_no, new_id) AS k FROM incoming_files), e AS (SELECT a AS x, b AS y FROM like_ UNION ALL SELECT b, a FROM like_), "
    "m AS (SELECT i.new_id, i.k, bool_or(f.k IS NULL) AS old, list(f.new_id) FILTER (WHERE f.k < i.k) AS earlier FROM i JOIN e ON e.x = i.new_id LEFT JOIN i f ON f.new_id = e.y GROUP BY i.new_id, i.k), "
    "y AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM m), walk(n, refused) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT y.n, CASE WHEN old OR len(list_filter(coalesce(earlier, []), lambda x: NOT list_contains(walk.refused, x))) > 0 THEN list_append(walk.refused, y.new_id) ELSE walk.refused END FROM walk JOIN y ON y.n = walk.n + 1) "
    "SELECT unnest(refused) AS new_id FROM (SELECT refused FROM walk ORDER BY n DESC LIMIT 1)"
)

_NGRAMS = r"SELECT {0} AS id, unnest(list_distinct(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' ')))) AS g FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1}) WHERE len(w) >= 12"
P9_FOUND = f"WITH i AS ({_NGRAMS.format('item_id', 'eval_items')}), d AS ({_NGRAMS.format('doc_id', 'documents')}) SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM i JOIN d USING (g)"

SQL = {"p1_found": P1_FOUND, "p1_links": P1_LINKS, "p1_groups": P1_GROUPS, "p1_members": P1_MEMBERS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p9_found": P9_FOUND}
