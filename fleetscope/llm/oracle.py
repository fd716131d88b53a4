"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
        WHEN len(words) > 0 THEN ['short ' || array_to_string(words, ' ')] ELSE [] END) AS g
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
few AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.* FROM s JOIN few USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP6 = r"""
WITH i AS (
    SELECT item_id, words, len(words) AS n, least(5, len(words)) AS w
    FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark) WHERE len(words) > 0),
ig AS (
    SELECT item_id, n, w, unnest(range(0, n - w + 1)) AS q,
           unnest(list_transform(range(1, n - w + 2), lambda k: array_to_string(words[k:k + w - 1], ' '))) AS g FROM i),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
ws AS (SELECT DISTINCT w FROM i),
dg AS (
    SELECT doc_id, w, len(words) AS len, unnest(range(0, len(words) - w + 1)) AS p,
           unnest(list_transform(range(1, len(words) - w + 2), lambda k: array_to_string(words[k:k + w - 1], ' '))) AS g
    FROM d, ws WHERE len(words) >= w),
v AS (SELECT DISTINCT doc_id, len, item_id, n, dg.w AS w, p - q AS s FROM dg JOIN ig ON dg.g = ig.g AND dg.w = ig.w),
c AS (SELECT *, greatest(s, 0) AS b, least(s + n, len) AS e FROM v),
x AS (
    SELECT c.doc_id, c.item_id, c.b, c.e, c.n, c.w, dg.g, count(*) AS k
    FROM c JOIN dg ON dg.doc_id = c.doc_id AND dg.w = c.w AND dg.p >= c.b AND dg.p <= c.e - c.w WHERE c.e - c.b >= c.w GROUP BY ALL),
y AS (SELECT item_id, w, g, count(*) AS k FROM ig GROUP BY ALL),
z AS (
    SELECT doc_id, x.item_id, b, e - b AS words, n, x.w AS w, sum(least(x.k, y.k)) AS common
    FROM x JOIN y ON x.item_id = y.item_id AND x.w = y.w AND x.g = y.g GROUP BY ALL),
r AS (SELECT doc_id, item_id, b, words, CAST(common AS DOUBLE) / CAST(words - w + 1 + n - w + 1 - common AS DOUBLE) AS similarity FROM z)
SELECT doc_id, item_id, similarity, CAST(b AS INTEGER) AS window_start, CAST(words AS INTEGER) AS window_words
FROM r WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, b, words DESC) = 1
"""

OP7 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP11 = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
    SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3 AND cut = 1) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b JOIN n USING (lang) LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""

OP12 = r"""
WITH t AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents),
f AS (
    SELECT row, doc_id, part,
           [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
            100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
    FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
g AS (
    SELECT part, list_transform(fails, lambda x: CAST(x AS INTEGER)) AS fails, count(*) AS n,
           sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS k),
o AS (
    SELECT [a.k, b.k, c.k, d.k, e.k] AS places
    FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT places, k AS step, places[k] AS filter, places[1:k - 1] AS before FROM o, i),
x AS (
    SELECT part, places, step, filter, n, good, bad, fails[filter] = 1 AS failing,
           len(list_filter(before, lambda b: fails[b] = 1)) > 0 AS gone, list_sum(fails) AS failed
    FROM g, s),
r AS (
    SELECT part, places, step, filter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failing AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
    FROM x GROUP BY ALL)
SELECT part, array_to_string(list_transform(places, lambda p: 'ABCDE'[p]), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""

ORACLE = {
    "op4_minhash": OP4, "op5_warc": OP5, "op6_decontamination": OP6, "op7_embedding_links": OP7, "op11_collocations": OP11, "op12_filter_audit": OP12,
}
